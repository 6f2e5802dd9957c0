"""One canonical text per attribute value, so that equal values have equal texts.

Numbers are compared as 32-bit reals (``n`` + text), inside lists as well;
other values keep their JSON text behind a letter for their type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page and session bookkeeping, which is not part of an element's content.
BOOKKEEPING = ("PGNO", "SESNO")


def real_text(value: str) -> str:
    """SQL: a number as the text of the 32-bit real next to it; -0 is 0."""
    return f"concat('n', cast(cast(cast({value} as double) as float) + cast(0 as float) as string))"


def variant_text(value: str, depth: int = 3) -> str:
    """SQL: canonical text of a variant. Lists are opened up to the given depth, deeper ones compare by JSON text."""
    kind = f"schema_of_variant({value})"
    number = f"({kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or {kind} like 'DECIMAL%')"
    lists = ""
    if depth:
        name = f"x{depth}"
        lists = f" when {kind} like 'ARRAY%' then concat('[', array_join(transform(try_variant_get({value}, '$', 'array<variant>'), {name} -> coalesce({variant_text(name, depth - 1)}, 'null')), ','), ']')"
    return f"case when {value} is null or {kind} = 'VOID' then null when {number} then {real_text(f"try_variant_get({value}, '$', 'double')")}{lists} else concat('j', to_json({value})) end"


def map_entries_of_json(json: str, ignore: tuple[str, ...] = BOOKKEEPING) -> Column:
    """A JSON object as a sorted array of (key, canonical text); null values and ignored keys are left out.

    A missing or unreadable text is an empty map.
    """
    skip = ", ".join(f"'{k}'" for k in ignore) or "''"
    kept = f"filter(transform(map_entries(from_json({json}, 'map<string,variant>')), e -> struct(e.key as key, {variant_text('e.value')} as value)), e -> e.value is not null and e.key not in ({skip}))"
    return F.expr(f"coalesce(array_sort({kept}), cast(array() as array<struct<key:string,value:string>>))")
