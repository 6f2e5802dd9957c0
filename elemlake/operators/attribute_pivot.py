"""Attribute-value rows into wide tables, by column-block pivoting.

Lines (entity, kind, key, value) are read as the type their kind's layout
gives them and reduced to one cell per entity and attribute with a map-side
combine. Attributes are divided into blocks. The cells are written once,
a partition per block, each hash-bucketed by entity in the same way; every
block is pivoted from its own partition and the blocks are joined on the
entity, so neither the pivots nor the joins shuffle and every cell is read
once. Of many blocks a lot at a time is joined and written in the same buckets, so no plan
grows with the number of attributes.

Defined results: null, empty and ``unset`` values say nothing; a line whose
type cannot be read and a cell with two different values give a null column
and put the attribute's name into ``unfilled``; an integer beyond 64 bits is
read, and compared digit by digit, but has no place in its column: the
attribute is named in ``beyond``; keys the layout does not
list are counted in ``n_unlisted``; repeated lines change nothing; an entity
with null in its key is an entity of its own; an empty table gives an empty
table with all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elemlake.plans.skew import block_of
from elemlake.plans.workspace import bucketed, release

#: Two readings of a number are the same within this.
TOLERANCE = 0.002
#: Rows of a layout up to which it is broadcast; a larger one is joined as any table.
MOST_BROADCAST = 200_000
#: The block of the rows that only name an entity.
SPINE = -1

# Units and what one is in the base unit; patterns of the value types.
UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "degc": 1.0, "pascal": 1.0, "kpa": 1000.0, "kg": 1.0}
NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?"
UNIT = r"(?i:mm|cm|m|degc|pascal|kpa|kg)"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
REAL_PATTERN = rf"^({NUMBER})(?: ?({UNIT}))?$"
AXIS_PATTERN = rf"([XEYNZU]) ({NUMBER})(?: ?({UNIT}))?"
POSITION_PATTERN = f"^{AXIS_PATTERN} {AXIS_PATTERN} {AXIS_PATTERN}$"
REFERENCE_PATTERN = r"^(=[0-9]+/[0-9]+|/[^\s]+)$"
AXES = "XEYNZU", "xxyyzz"


@dataclass(frozen=True)
class WideColumn:
    attr: str
    kind: str  # number, integer, boolean, text, position
    name: str


_STORED = {"Integer": "integer", "Real": "number", "Boolean": "boolean", "Position": "position", "Text": "text", "Enum": "text", "Reference": "text"}
_SQL = {"integer": "bigint", "number": "double", "boolean": "boolean", "position": "array<double>", "text": "string"}


def wide_columns(layout: DataFrame) -> list[WideColumn]:
    """One column per attribute, or per attribute and stored type where nouns disagree. Names and types are schema, which the driver must know."""
    kinds: dict[str, set[str]] = {}
    for r in layout.select("attr", "attr_type").where("attr is not null").distinct().collect():
        kinds.setdefault(r["attr"], set()).add(_STORED.get(r["attr_type"], "text"))
    out = []
    for attr in sorted(kinds):
        for kind in sorted(kinds[attr]):
            out.append(WideColumn(attr, kind, attr if len(kinds[attr]) == 1 else f"{attr}_{kind}"))
    return out


def is_small(layout: DataFrame) -> bool:
    """Whether the layout's checked size allows to broadcast it."""
    return layout.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _unit(unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, by in UNITS.items():
        if by != 1.0:
            factor = F.when(F.lower(unit) == name, F.lit(by)).otherwise(factor)
    return factor


def read_cells(lines: DataFrame, layout: DataFrame, small: bool = True) -> DataFrame:
    """One row per entity and listed attribute: its value by type, and whether the cell can be filled. small allows to broadcast the layout."""
    value = F.trim("value")
    said = F.col("value").isNotNull() & (value != "") & (F.lower(value) != "unset")
    rows = lines.where(said).select(
        F.struct("source", "elem_no").alias("entity"),
        F.upper(F.substring(F.trim("kind"), 1, 4)).alias("noun"),
        F.upper(F.trim("key")).alias("attr"),
        value.alias("v"),
    )
    known = layout.where("noun is not null and attr is not null").select("noun", "attr", "attr_type", F.xxhash64("attr_type").alias("typed")).distinct()
    rows = rows.join(F.broadcast(known) if small else known, ["noun", "attr"])

    kind, v = F.col("attr_type"), F.col("v")

    def groups(of: str, pattern: str, n: int) -> Column:
        """All groups of a pattern from one match, null if it is another type or does not match."""
        return F.when((kind == of) & v.rlike(pattern), F.split(F.regexp_replace(v, pattern, "|".join(f"${i}" for i in range(1, n + 1))), r"\|"))

    rows = rows.select("*", groups("Real", REAL_PATTERN, 2).alias("r"), groups("Position", POSITION_PATTERN, 9).alias("p"))

    def length(found: str, at: int) -> Column:
        return F.get(found, F.lit(at)).cast("double") * _unit(F.get(found, F.lit(at + 1)))

    axis = [F.translate(F.get("p", F.lit(i)), *AXES) for i in (0, 3, 6)]
    along = [length("p", i) for i in (1, 4, 7)]
    position_ok = F.concat(*axis).isin("xyz", "xzy", "yxz", "yzx", "zxy", "zyx")

    def on(letter: str) -> Column:
        return F.coalesce(*[F.when(a == letter, x) for a, x in zip(axis, along)])

    lower = F.lower(v)
    boolean = F.when(F.lit("true").startswith(lower), F.lit(1.0)).when(F.lit("false").startswith(lower), F.lit(0.0))
    x = F.when(kind == "Real", length("r", 0)).when(kind == "Boolean", boolean).when(kind == "Position", F.when(position_ok, on("x")))
    y, z = (F.when(position_ok, on(c)) for c in "yz")
    text = F.when(kind == "Reference", F.when(v.rlike(REFERENCE_PATTERN), v)).when(
        kind.isin("Text", "Enum") | ~kind.isin(*_STORED),
        F.when(v.rlike("(?s)^'.*'$") & (F.length(v) > 1), F.expr("substring(v, 2, length(v) - 2)")).otherwise(v),
    )
    # Integers of any length are compared by their digits.
    plain = F.regexp_replace(v, r"^\+?(-?)0*(?=[0-9])", "$1")
    digits = F.when(kind == "Integer", F.when(v.rlike(INTEGER_PATTERN), F.when(plain == "-0", "0").otherwise(plain)))
    rows = rows.select("entity", "attr", "typed", x.alias("x"), y.alias("y"), z.alias("z"), text.alias("t"), digits.alias("digits"))
    whole = F.col("digits").try_cast("bigint")
    rows = rows.select("entity", "attr", "typed", "x", "y", "z", F.coalesce("t", "digits").alias("t"), whole.alias("w"), (F.col("digits").isNotNull() & whole.isNull()).alias("beyond"))

    cells = rows.groupBy("entity", "attr").agg(
        F.max(F.col("x").isNull() & F.col("t").isNull()).alias("unread"), F.max("beyond").alias("beyond"), F.min("w").alias("w"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y", "z", "t", "typed") for f in (F.min, F.max)],
    )
    apart = F.lit(False)
    for c in "xyz":
        apart = apart | F.coalesce(F.col(f"max_{c}") - F.col(f"min_{c}") > TOLERANCE + 1e-9, F.lit(False))
    for c in ("t", "typed"):
        apart = apart | F.coalesce(F.col(f"max_{c}") != F.col(f"min_{c}"), F.lit(False))
    bad = F.col("unread") | apart
    return cells.select("entity", "attr", bad.alias("bad"), (F.col("beyond") & ~bad).alias("beyond"), *[F.col(f"min_{c}").alias(c) for c in ("x", "y", "z", "t", "typed")], "w")


def _block(store: DataFrame, number: int, columns: list[WideColumn]) -> DataFrame:
    """One block of attributes, pivoted: (entity, a column each, names of cells that are not filled or not held)."""
    aggregates = [F.array_compact(F.collect_set(F.when(F.col(mark), F.col("attr")))).alias(f"_{name}_{number}") for mark, name in (("bad", "unfilled"), ("beyond", "beyond"))]
    for c in columns:
        typed = F.col("typed").isin([F.xxhash64(F.lit(t)) for t, k in _STORED.items() if k == c.kind])
        if c.kind == "text":
            typed = typed | ~F.col("typed").isin([F.xxhash64(F.lit(t)) for t in _STORED])
        mine = (F.col("attr") == c.attr) & ~F.col("bad") & typed
        if c.kind == "position":
            value = F.when(F.max(F.when(mine, F.col("x"))).isNotNull(), F.array(*[F.max(F.when(mine, F.col(k))) for k in "xyz"]))
        elif c.kind == "boolean":
            value = F.max(F.when(mine, F.col("x"))) == 1.0
        else:
            value = F.max(F.when(mine, F.col({"integer": "w", "number": "x", "text": "t"}[c.kind])))
        aggregates.append(value.cast(_SQL[c.kind]).alias(c.name))
    return store.where(F.col("block") == number).groupBy("entity").agg(*aggregates)


def wide_table(lines: DataFrame, layout: DataFrame, block_size: int = 32, buckets: int | None = None, blocks_per_plan: int = 8) -> DataFrame:
    """One row per (source, elem_no): a typed column per attribute, ``unfilled``, ``beyond`` and ``n_unlisted``.

    block_size attributes are pivoted together, which bounds the aggregation
    buffer of one pass however many attributes there are.
    """
    columns, small = wide_columns(layout), is_small(layout)
    attrs = sorted({c.attr for c in columns})
    number = {attr: i // block_size for i, attr in enumerate(attrs)}
    blocks: list[list[WideColumn]] = [[] for _ in range(-(-len(attrs) // block_size))]
    for c in columns:
        blocks[number[c.attr]].append(c)
    ends = attrs[block_size - 1 : -1 : block_size]  # the last attribute of every block but the last
    listed = layout.where("noun is not null and attr is not null").select("noun", "attr").distinct().withColumn("listed", F.lit(True))
    spine = (
        lines.select(F.struct("source", "elem_no").alias("entity"), F.upper(F.substring(F.trim("kind"), 1, 4)).alias("noun"), F.upper(F.trim("key")).alias("attr"))
        .groupBy("entity", "noun", "attr").count()
        .join(F.broadcast(listed) if small else listed, ["noun", "attr"], "left")
        .groupBy("entity")
        .agg(F.count_if(F.col("listed").isNull() & F.col("attr").isNotNull()).cast("int").alias("n_unlisted"))
    )
    cells = read_cells(lines, layout, small).withColumn("block", block_of(F.col("attr"), ends))
    store = bucketed(
        cells.unionByName(spine.select("entity", F.lit(SPINE).alias("block"), "n_unlisted"), allowMissingColumns=True),
        "cells", ["entity"], partition_by=["block"], buckets=buckets,
    )
    parts = [_block(store, k, block) for k, block in enumerate(blocks)]
    while len(parts) > blocks_per_plan:
        lots = [parts[i : i + blocks_per_plan] for i in range(0, len(parts), blocks_per_plan)]
        joined = [_joined(lot, "full") for lot in lots]
        made = [bucketed(part, "cell-blocks", ["entity"], buckets=buckets, placed=True) for part in joined]
        for part in parts:
            release(part)
        parts = made
    out = _joined([store.where(F.col("block") == SPINE).select("entity", "n_unlisted"), *parts], "left")

    def names(kind: str) -> Column:
        found = [F.coalesce(F.col(f"_{kind}_{k}"), F.array().cast("array<string>")) for k in range(len(blocks))]
        return (F.array_sort(F.concat(*found)) if found else F.array().cast("array<string>")).alias(kind)

    return out.select("entity.source", "entity.elem_no", *[c.name for c in columns], names("unfilled"), names("beyond"), "n_unlisted")


def _joined(parts: list[DataFrame], how: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "entity", how)
    return out


def unfilled_cells(lines: DataFrame, layout: DataFrame, **options) -> DataFrame:
    """(source, elem_no, key) of the cells of the wide table that could not be filled although lines name them."""
    return wide_table(lines, layout, **options).select("source", "elem_no", F.explode("unfilled").alias("key"))


def long_form(wide: DataFrame) -> DataFrame:
    """The filled cells of a wide table, a row each: (source, elem_no, column, number, text); positions and booleans as text."""
    parts = []
    for f in wide.schema:
        if f.name in ("source", "elem_no", "unfilled", "beyond", "n_unlisted"):
            continue
        kind = f.dataType.simpleString()
        number = F.col(f"`{f.name}`").cast("double") if kind in ("bigint", "double") else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if kind in ("bigint", "double") else F.array_join(F.transform(f"`{f.name}`", lambda x: F.round(x, 3).cast("string")), " ") if kind.startswith("array") else F.col(f"`{f.name}`").cast("string")
        parts.append(F.struct(F.lit(f.name).alias("column"), number.alias("number"), text.alias("text")))
    cells = F.filter(F.array(*parts), lambda c: c["number"].isNotNull() | c["text"].isNotNull())
    return wide.select("source", "elem_no", F.explode(cells).alias("c")).select("source", "elem_no", "c.*")
