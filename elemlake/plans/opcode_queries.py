"""Every operator of the expression language over the attributes of all versions, with the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.functions.expressions import Options, compile_expression, encode_words, opcode_histogram, tree_of_payload
from elemlake.functions.names import python_name_hash
from elemlake.operators import lookup
from elemlake.tables import table


def attribute(name: str, low: int = 0, high: int = 0) -> list[int]:
    return [0x6A, 0, python_name_hash(name), low, high, 0]


def number(n: int) -> list[int]:
    return [0x65, 2, n]


def text(s: str) -> list[int]:
    return [0x66, len(s), *map(ord, s)]


M, A, D, N, P = (attribute(name) for name in ("MASS", "ANGL", "DESC", "NAME", "POS"))
RATIO = [*A, *number(9000), 805]  # between 0 and 1
HEAVY = [*M, *number(1000), 601]

# Opcode: postfix words over the attributes, and the same in SQL over columns m, a, d, n and p.
NUMBERS = {
    801: ([*M, 801], "-m"), 802: ([*M, *A, 802], "m + a"), 803: ([*M, *A, 803], "m - a"), 804: ([*M, *A, 804], "m * a"), 805: ([*M, *A, 805], "m / nullif(a, 0)"),
    901: ([*A, 901], "sin(radians(a))"), 902: ([*A, 902], "cos(radians(a))"), 903: ([*RATIO, 903], "tan(radians(a / 9000))"), 904: ([*RATIO, 904], "degrees(asin(a / 9000))"), 905: ([*RATIO, 905], "degrees(acos(a / 9000))"),
    906: ([*A, 906], "degrees(atan(a))"), 907: ([*M, *A, 907], "degrees(atan2(m, a))"), 1001: ([*M, 1001], "sqrt(m)"), 1002: ([*RATIO, *number(3), 1002], "(a / 9000) ** 3"), 1003: ([*M, 1003], "ln(m)"), 1004: ([*RATIO, 1004], "exp(a / 9000)"),
    1005: ([*M, 801, 1005], "trunc(-m)"), 1006: ([*M, 1006], "round(m)"), 1007: ([*M, *A, 803, 1007], "abs(m - a)"), 1008: ([*M, *A, 1008], "greatest(m, a)"), 1009: ([*M, *A, 1009], "least(m, a)"), 1010: ([*M, 1010], "m"), 1011: ([*M, 1011], "m / 1000"), 1012: ([*D, 1012], "try_cast(d as double)"),
    1101: ([*P, *number(1), 1101], "p[1]"), 1102: ([*P, *number(2), 1102], "p[2]"), 1103: ([*P, *number(3), 1103], "p[3]"), 1201: ([*M, 1201], "a"), 1301: ([*D, 1301], "length(d)"), 1302: ([*N, 1302], "try_cast(n as double)"), 1303: ([*N, *text("-"), 1303], "instr(n, '-')"),
    1313: ([*P, 1313], "len(p)"), 1316: ([*D, 1316], "length(d)"), 1321: ([*N, *text("0"), 1321], "length(n) - length(replace(n, '0', ''))"), 1370: ([*M, *number(7), 1370], "coalesce(m, 7)"), 1401: ([*D, 1401], "try_cast(d as double)"), 1822: ([*HEAVY, *M, *A, 1822], "case when m > 1000 then m else a end"),
    1824: ([*A, 1824], "a / 1000"), 1827: ([*P, *number(4), 1827], "p[4]"), 0x6F: ([0x6F, *M, 804], "pi() * m"),
}
TEXTS = {
    1304: ([*N, *text("-"), 1304], "case when n is null then '' when instr(n, '-') > 0 then substr(n, instr(n, '-') + 1) else '' end"), 1305: ([*N, *text("-"), 1305], "case when instr(n, '-') > 0 then substr(n, 1, instr(n, '-') - 1) else '' end"),
    1306: ([*D, *text("<%s>"), 1306], "case when d is null then '<null>' else '<' || d || '>' end"), 1307: ([*D, 1307], "upper(d)"), 1308: ([*N, 1308], "lower(n)"), 1309: ([*N, *number(2), *number(4), 1309], "substr(n, 2, 4)"), 1314: ([*D, 1314], "trim(d)"), 1317: ([*D, *number(2), 1317], "string_split(d, ' ')[2]"),
    1322: ([*N, *text("-"), *text(".*"), 1322], "replace(n, '-', '.*')"), 1369: ([*D, *text("none"), 1369], "coalesce(d, 'none')"), 1410: ([*M, 1006, 1410], "cast(cast(round(m) as bigint) as varchar)"), 1829: ([*N, *text("-"), 1829, *number(2), 1101], "string_split(n, '-')[2]"), 0x6A: ([*attribute("NAME", 2, 3)], "substr(n, 2, 2)"),
}
TRUTHS = {
    301: ([*HEAVY, 301], "not m > 1000"), 302: ([*HEAVY, *A, *number(90), 603, 302], "m > 1000 and a < 90"), 303: ([*HEAVY, *A, *number(90), 603, 303], "m > 1000 or a < 90"), 401: ([*D, *N, 401], "d = n"), 501: ([*M, *A, 501], "m <> a"), 601: (HEAVY, "m > 1000"), 602: ([*M, *A, 602], "m > a"), 603: ([*M, *A, 603], "m < a"), 605: ([*M, *A, 605], "m >= a"), 607: ([*M, *A, 607], "m <= a"),
    1311: ([*M, 1311], "m is not null"), 1312: ([*M, 1312], "m is null"), 1315: ([*N, *text("/?-*_%0"), 1315], "regexp_full_match(n, '/.-.*_%0')"), 1825: ([*A, *M, 1825], "a is not null"), 1826: ([*A, 1826], "a is null"), 1828: ([*D, 1828], "d = ''"), 0x67: ([0x67, 201, *HEAVY, 302], "m > 1000"),
}


def _name(opcode: int) -> str:
    return f"op_{opcode}"


def _values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "attrs_long").where(F.col("key").isin("MASS", "ANGL", "DESC", "NAME", "POS")).groupBy(*lookup.VERSION)
    value = {"MASS": F.coalesce("v_double", F.col("v_int").cast("double")), "ANGL": F.coalesce("v_double", F.col("v_int").cast("double")), "DESC": F.col("v_str"), "NAME": F.col("v_str"), "POS": F.col("v_doubles")}
    return rows.agg(*[F.max(F.when(F.col("key") == key, v)).alias(key) for key, v in value.items()])


def _evaluated(spark: SparkSession, sf: str, expressions: dict[int, tuple[list[int], str]], round_to: int | None) -> DataFrame:
    options = Options(distance_factor=0.001)
    columns = []
    for opcode, (words, _) in expressions.items():
        c = compile_expression(tree_of_payload(encode_words(words)), F.col, lambda name: F.col("ANGL"), options)  # every variable stands for the angle
        columns.append((F.round(c.cast("double"), round_to) if round_to is not None else c).alias(_name(opcode)))
    return _values(spark, sf).select(*lookup.VERSION, *columns)


def opcode_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, NUMBERS, 6)


def opcode_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, TEXTS, None)


def opcode_truths(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, TRUTHS, None)


def opcode_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How often each opcode occurs if every version with a name carries all the expressions above, one payload a row."""
    payloads = [bytearray(encode_words(words)) for group in (NUMBERS, TEXTS, TRUTHS) for words, _ in group.values()]
    named = table(spark, sf, "element_versions").where("name is not null").select(*lookup.VERSION).distinct()
    return opcode_histogram(named.select(F.explode(F.array(*[F.lit(p) for p in payloads])).alias("payload")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (opcode_numbers, opcode_texts, opcode_truths, opcode_usage)}

_ROWS = "with v as (select dbnum, ref0, ref1, sesno, max(coalesce(v_double, v_int)) filter (key = 'MASS') as m, max(coalesce(v_double, v_int)) filter (key = 'ANGL') as a, max(v_str) filter (key = 'DESC') as d, max(v_str) filter (key = 'NAME') as n, max(v_doubles) filter (key = 'POS') as p from attrs_long where key in ('MASS', 'ANGL', 'DESC', 'NAME', 'POS') group by 1, 2, 3, 4)"


def _sql(expressions: dict[int, tuple[list[int], str]], form: str) -> str:
    columns = ", ".join(f"{form.format(sql)} as {_name(opcode)}" for opcode, (_, sql) in expressions.items())
    return f"{_ROWS} select dbnum, ref0, ref1, sesno, {columns} from v"


def _usage() -> dict[int, int]:
    """Opcodes of the expressions above, counted by reading their words as they were written: values take words of their own."""
    counts: dict[int, int] = {}
    for group in (NUMBERS, TEXTS, TRUTHS):
        for words, _ in group.values():
            at = 0
            while at < len(words):
                counts[words[at]] = counts.get(words[at], 0) + 1
                opcode = words[at]
                at += 1 + words[at + 1] if opcode == 0x65 else 2 + words[at + 1] if opcode == 0x66 else {0x67: 2, 0x6A: 6}.get(opcode, 1)
    return counts


ORACLES: dict[str, str] = {
    "opcode_numbers": _sql(NUMBERS, "round(cast({} as double), 6)"),
    "opcode_texts": _sql(TEXTS, "{}"),
    "opcode_truths": _sql(TRUTHS, "({})"),
    "opcode_usage": "select o.opcode, o.n * v.n as n, true as known from (values " + ", ".join(f"({k}, {n})" for k, n in _usage().items()) + ") o(opcode, n), (select count(*) as n from (select distinct dbnum, ref0, ref1, sesno from element_versions where name is not null)) v",
}
