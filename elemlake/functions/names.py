"""Names, hashes and reference texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hash of the empty name; names are numbers to base 27 above it, first letter least.
HASH_BASE, LETTERS = 531441, 27


def name_hash(name: Column) -> Column:
    """Hash of an upper-case name: letters A to Z are the digits 1 to 26. A user attribute's colon does not count; null if another character occurs."""
    name = F.regexp_replace(name, "^:", "")
    digits = F.transform(F.split(name, ""), lambda c: F.ascii(c) - 64)
    value = F.aggregate(F.reverse(digits), F.lit(0).cast("bigint"), lambda sofar, d: sofar * LETTERS + d)
    return F.when(name.rlike("^[A-Z]{1,12}$"), value + HASH_BASE)


def name_of_hash(value: Column) -> Column:
    """The name of a hash, at most 12 letters; null for a number that is no name's."""
    rest = value.cast("bigint") - HASH_BASE
    places = F.array(*[F.lit(LETTERS**i).cast("bigint") for i in range(12)])
    digits = F.transform(places, lambda p: F.expr("0") + F.pmod(F.floor(rest / p), F.lit(LETTERS)))
    text = F.array_join(F.transform(digits, lambda d: F.when(d == 0, "").otherwise(F.char(d + 64))), "")
    return F.when((rest > 0) & (name_hash(text) == value), text)


def python_name_hash(name: str) -> int:
    return HASH_BASE + sum((ord(c) - 64) * LETTERS**i for i, c in enumerate(name))


def python_name_of_hash(value: int) -> str | None:
    """The name of a hash; negative hashes name the same attribute negated."""
    rest, out = abs(value) - HASH_BASE, []
    if rest <= 0:
        return None
    while rest:
        rest, digit = divmod(rest, LETTERS)
        if digit == 0:
            return None
        out.append(chr(64 + digit))
    return "".join(out)


def uda_label(key: Column) -> Column:
    """UDA_<name> of a user attribute; UDA_HASH_<number> where only the hash is known."""
    bare = F.regexp_replace(key, "^:+", "")
    return F.when(bare.rlike("^-?[0-9]+$"), F.concat(F.lit("UDA_HASH_"), bare)).otherwise(F.concat(F.lit("UDA_"), bare))


def refno_text(ref0: Column, ref1: Column, separator: str = "/") -> Column:
    return F.concat_ws(separator, ref0.cast("string"), ref1.cast("string"))


def parse_refno(text: Column) -> Column:
    """`=a/b`, `a/b` or `a_b` as struct<ref0, ref1>; null if it is none."""
    form = r"^\s*=?([0-9]{1,10})[/_]([0-9]{1,10})\s*$"
    parts = F.struct(F.regexp_extract(text, form, 1).try_cast("bigint").alias("ref0"), F.regexp_extract(text, form, 2).try_cast("bigint").alias("ref1"))
    return F.when(text.rlike(form), parts)


def one_space(text: Column) -> Column:
    """White space collapsed to single blanks, outer ones removed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquoted(text: Column) -> Column:
    """Without an enclosing pair of single quotes; doubled quotes inside become single ones."""
    inner = F.regexp_extract(text, "(?s)^'(.*)'$", 1)
    return F.when(text.rlike("(?s)^'.*'$") & (F.length(text) > 1), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(text)
