"""Small stored literals as columns: directions, axes, tenths, page buckets and addresses, expression scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction codes, axis codes, names of special references, marks that speak for an expression text.
DIRECTIONS = {11: "X", 12: "-X", 13: "Y", 14: "-Y", 15: "Z", 16: "-Z"}
AXES = {1: "X", 2: "Y", 3: "Z"}
NEGATIVE = 2
SPECIAL = ("PREV", "NEXT", "BLRF NUM 1", "CATR", "BLTP 1")
ANGLE_WORDS = {-5: "DDHEIGHT", -4: "DDANGLE", -3: "DDRADIUS"}
SIGNED_AXES = {1: "X", 2: "Y", 3: "Z", 4: "-X", 5: "-Y", 6: "-Z"}
# Where the ranges of parameter numbers begin: design, inner, twice, twice design, twice inner; and the negative points.
DESIGN, INNER, TWICE, TWICE_DESIGN, TWICE_INNER, TWICE_END, NEGATIVE_POINTS = 50, 101, 501, 550, 601, 1001, 1000
AXIS, NEGATIVE_AXIS, POINT, AXIS_FLAG = 1, 2, 3, 2


def _case(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def direction(code: Column) -> Column:
    """A signed axis; null for another code."""
    return _case(code, DIRECTIONS)


def tenths(raw: Column) -> Column:
    """A number stored as negative tenths."""
    return -raw.cast("double") / 10


def fortieths(raw: Column, decimals: int) -> Column:
    """A number stored in fortieths, with two or three decimals: halves are rounded away from zero, but a small one whose last digit is 7 is cut off."""
    scaled = raw.cast("float") / F.lit(40.0).cast("float") * F.lit(float(10**decimals)).cast("float")
    whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return F.when((whole % 10 == 7) & (scaled < 100), whole.cast("double")).otherwise(F.round(scaled.cast("double"))) / 10**decimals


def axis(code: Column, sign: Column) -> Column:
    """An axis with its sign flag; null for another code."""
    name = _case(code, AXES)
    return F.when(sign == NEGATIVE, F.concat(F.lit("-"), name)).otherwise(name)


def angle_or_number(raw: Column) -> Column:
    """A word for a design angle, or a number stored as negative tenths, as text."""
    number = tenths(raw)
    return F.coalesce(_case(raw, ANGLE_WORDS), F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string")))


def parameter(raw: Column) -> Column:
    """The text of a parameter number; negative ones are angles and numbers, those beyond all ranges say nothing."""
    named = lambda words, less: F.concat(F.lit(words + " "), (raw - less).cast("string"))
    return (
        F.when(raw < 0, angle_or_number(raw))
        .when(raw < DESIGN, named("PARAM", 0)).when(raw < INNER, named("DESIGN PARAM", DESIGN)).when(raw < TWICE, named("IPARAM", INNER - 1))
        .when(raw < TWICE_DESIGN, named("TWICE PARAM", TWICE - 1)).when(raw < TWICE_INNER, named("TWICE DESIGN PARAM", TWICE_DESIGN)).when(raw < TWICE_END, named("IPARAM", TWICE_INNER - 1))
        .when(raw >= TWICE_END, F.lit(""))
    )


def implicit_axis(flag: Column, kind: Column, value: Column) -> Column:
    """The text of an axis in the fixed part of a record, from its three words; null for another form.

    Kind 1 is an axis, 2 its negative, 3 a point; any other kind names two signed axes by its two digits, with an angle between them:
    a parameter, or whole degrees in hundredths if the kind is negative.
    """
    first, second = (_case(F.floor(F.abs(kind) / 10) if place else F.abs(kind) % 10, SIGNED_AXES) for place in (1, 0))
    degrees = F.when(value < 0, F.ceil(value / 100)).otherwise(F.floor(value / 100)).cast("string")
    between = F.when(kind < 0, degrees).otherwise(parameter(value))
    point = F.when(value >= NEGATIVE_POINTS, F.concat(F.lit("-P"), (value - NEGATIVE_POINTS).cast("string"))).otherwise(F.concat(F.lit("P"), value.cast("string")))
    text = (
        F.when(kind == AXIS, _case(value, AXES)).when(kind == NEGATIVE_AXIS, F.concat(F.lit("-"), _case(value, AXES)))
        .when(kind == POINT, point).otherwise(F.concat(first, F.lit(" "), between, F.lit(" "), second))
    )
    return F.when(flag == AXIS_FLAG, text)


def bucket_id(subtype: Column) -> Column:
    """Bucket number in a data page's subtype word."""
    return F.shiftright(subtype, 13).bitwiseAND(F.lit(0x1FFF))


def byte_address(page: Column, packed: Column, page_size: int) -> Column:
    """Where an index entry points: the upper 20 bits of its packed word are an offset in half words."""
    return page.cast("bigint") * page_size + F.shiftrightunsigned(packed.bitwiseAND(F.lit(0xFFFFFFFF)), 12) * 2


def entry_flag(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFF))


def expression_score(text: Column) -> Column:
    """How much an expression text says: parameters 10, design parameters 8, operators 3, a bare number -5. Of two texts the better one is kept."""
    number = text.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$")
    return (
        F.when(text.contains("PARA["), 10).otherwise(0) + F.when(text.rlike(r"(DESP|DDES|WDES)\["), 8).otherwise(0)
        + F.when(text.rlike(r"[/*+]"), 3).otherwise(0) - F.when(number, 5).otherwise(0)
    )


def better_text(new: Column, legacy: Column, legacy_wins_ties: bool = True) -> Column:
    """The text of the higher score; blanks never win over a text."""
    n, l = (F.coalesce(F.trim(c), F.lit("")) for c in (new, legacy))
    wins = expression_score(l) >= expression_score(n) if legacy_wins_ties else expression_score(l) > expression_score(n)
    return F.when((l != "") & ((n == "") | wins), legacy).otherwise(new)
