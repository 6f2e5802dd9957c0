"""History of changing entity attributes in insert-only satellites.

The attributes are split by how often they change: over all rows, the
distinct values an element had of an attribute against the sessions that wrote it.
Each satellite holds a row per element and session in which the hash of its
attributes differs from the row before (hash-diff), with those attributes
and their values; rows are only ever appended. End sessions are not stored:
views compute them with lead(). What an element was at any session can be
read from its satellites alone.

Defined results: rows repeated or differing in kind and tag change nothing;
unset attributes are absent; numbers are compared as 32-bit reals, and of
equal ones the least text is kept; of two different values of one attribute
in one session both count and are kept; rows without an element or session
name no version and take no part; empty tables give no rows.

Group sizes: after the first aggregation there is one row per element and
session, so a window over one element never holds more rows than its database
has sessions, whatever share of the input rows is its. A view that reads no
attributes (periods) has none aggregated: the optimizer prunes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.values import BOOKKEEPING, real_text

VERSION = ["dbnum", "ref0", "ref1", "sesno"]
ELEMENT = ["dbnum", "ref0", "ref1"]
SATELLITES = ("slow", "fast")
#: Names of fast attributes that are compared as constants; more are looked up in a table.
MOST_CONSTANTS = 1024


def value_text() -> Column:
    """Canonical text of the value columns of attrs_long; null if the attribute is unset."""
    numbers = f"concat('[', array_join(transform(v_doubles, x -> coalesce({real_text('x')}, 'null')), ','), ']')"
    ints = f"concat('[', array_join(transform(v_ints, x -> coalesce({real_text('x')}, 'null')), ','), ']')"
    return F.expr(
        f"case when v_int is not null then {real_text('v_int')} when v_double is not null then {real_text('v_double')}"
        f" when v_bool is not null then concat('b', v_bool) when v_str is not null then concat('s', v_str)"
        f" when v_doubles is not null then {numbers} when v_ints is not null then {ints}"
        f" when v_strs is not null then concat('t', to_json(v_strs)) when v_refs is not null then concat('r', to_json(v_refs)) end"
    )


def value_json() -> Column:
    """The value itself as JSON text, for keeping; null if the attribute is unset."""
    return F.expr(
        "coalesce(cast(v_int as string), cast(v_double as string), cast(v_bool as string), to_json(cast(v_str as variant)),"
        " to_json(v_doubles), to_json(v_ints), to_json(v_strs), to_json(v_refs))"
    )


def set_attributes(attrs: DataFrame) -> DataFrame:
    """(VERSION, key, h, value): the content of the versions, a hash and the value per set attribute."""
    named = attrs.where(" and ".join(f"{c} is not null" for c in VERSION))
    content = ~F.col("key").isin(*BOOKKEEPING) | F.col("key").isNull()
    text = value_text()
    return named.where(content).select(*VERSION, "key", F.when(text.isNotNull(), F.xxhash64("key", text)).alias("h"), value_json().alias("value"))


def change_rates(attrs: DataFrame) -> DataFrame:
    """(key, rate): of the versions that wrote an attribute, the share that brought a new value. Sketches with a map-side combine."""
    rows = set_attributes(attrs).where("h is not null")
    seen = rows.groupBy("key").agg(
        F.approx_count_distinct(F.xxhash64(*ELEMENT, "h")).alias("values"),
        F.approx_count_distinct(F.xxhash64(*ELEMENT)).alias("elements"),
        F.count(F.lit(1)).alias("writes"),
    )
    return seen.select("key", (F.greatest(F.col("values") - F.col("elements"), F.lit(0)) / F.col("writes")).alias("rate"))


def fast_attributes(attrs: DataFrame, rate: float = 0.1) -> DataFrame:
    """(key) of the fast satellite's attributes, whose rate is at least the given one."""
    return change_rates(attrs).where((F.col("rate") >= rate) & F.col("key").isNotNull()).select("key")


def _with_speed(rows: DataFrame, fast: DataFrame | list[str]) -> DataFrame:
    """rows with ``is_fast``. A few names become constants of the plan, so that rows need not move; more are joined."""
    if isinstance(fast, DataFrame):
        few = [r["key"] for r in fast.limit(MOST_CONSTANTS + 1).collect()]
        if len(few) > MOST_CONSTANTS:
            return rows.join(fast.distinct().withColumn("is_fast", F.lit(True)), "key", "left").withColumn("is_fast", F.coalesce("is_fast", F.lit(False)))
        fast = sorted(few)
    return rows.withColumn("is_fast", F.coalesce(F.col("key").isin(fast), F.lit(False)) if fast else F.lit(False))


def version_rows(attrs: DataFrame, versions: DataFrame, fast: DataFrame | list[str]) -> DataFrame:
    """One row per element and session: (VERSION, removed, slow, fast, slow_attributes, fast_attributes), each satellite's attributes with one hash.

    Attribute rows and versions meet in one aggregation: attrs_long is read and shuffled once.
    """
    rows = _with_speed(set_attributes(attrs), fast)
    # A version without attribute rows is an element with an empty map.
    both = rows.unionByName(
        versions.where(" and ".join(f"{c} is not null" for c in VERSION)).select(*VERSION, F.struct("byte_offset", F.coalesce("deleted", F.lit(False)).alias("deleted")).alias("state")),
        allowMissingColumns=True,
    )
    mine = {"slow": ~F.col("is_fast"), "fast": F.col("is_fast")}
    # Sets are combined before the shuffle, so repeated rows don't travel.
    seen = both.groupBy(*VERSION).agg(
        F.max("state").alias("state"),
        *[F.collect_set(F.when(own, F.col("h"))).alias(f"{name}_set") for name, own in mine.items()],
        *[F.collect_set(F.when(own & F.col("h").isNotNull(), F.struct("key", "h", "value"))).alias(f"{name}_rows") for name, own in mine.items()],
    )
    removed = F.coalesce("state.deleted", F.lit(False))

    def kept(name: str) -> Column:
        """One value for each content."""
        return F.expr(f"transform(filter(array_sort({name}_rows), (x, i) -> i = 0 or get(array_sort({name}_rows), i - 1).h != x.h), x -> struct(x.key, x.value))")

    columns = [F.when(~removed, F.xxhash64(F.array_sort(f"{name}_set"))).alias(name) for name in SATELLITES]
    columns += [F.when(~removed, kept(name)).alias(f"{name}_attributes") for name in SATELLITES]
    return seen.select(*VERSION, removed.alias("removed"), *columns)


def _chosen(column: str) -> Column:
    return F.when(F.col("satellite") == "slow", F.col(f"slow{column}")).otherwise(F.col(f"fast{column}"))


def changed_rows(rows: DataFrame, known: Column | None = None) -> DataFrame:
    """The satellites' rows of versions: (VERSION, satellite, hash, removed, attributes), where hash or existence differs from the version before.

    known is what stood before an element's first row: a map of satellite to (hash, removed).
    """
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")

    def differs(name: str) -> Column:
        now = F.struct(F.col(name).alias("hash"), F.col("removed"))
        before = F.lag(now).over(order)
        return ~now.eqNullSafe(before if known is None else F.coalesce(before, known[name]))

    names = F.array_compact(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in SATELLITES]))
    marked = rows.withColumns({f"_{name}": differs(name) for name in SATELLITES})
    return marked.withColumn("satellite", F.explode(names)).select(*VERSION, "satellite", _chosen("").alias("hash"), "removed", _chosen("_attributes").alias("attributes"))


def satellites(attrs: DataFrame, versions: DataFrame, rate: float = 0.1) -> DataFrame:
    """Both satellites' rows."""
    return changed_rows(version_rows(attrs, versions, fast_attributes(attrs, rate)))


def append_satellites(stored: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The rows that sessions after the stored ones add. new_rows comes from version_rows(); stored stays as it is."""
    newest = stored.groupBy(*ELEMENT, "satellite").agg(F.max(F.struct("sesno", "hash", "removed")).alias("last"))
    last = newest.groupBy(*ELEMENT).agg(F.map_from_entries(F.collect_list(F.struct("satellite", F.struct("last.hash", "last.removed")))).alias("known"), F.max("last.sesno").alias("upto"))
    fresh = new_rows.join(last, ELEMENT, "left").where("upto is null or sesno > upto")
    return changed_rows(fresh, F.col("known"))


def satellite_periods(appended: DataFrame) -> DataFrame:
    """The view with ends: (ELEMENT, satellite, hash, from_sesno, to_sesno, attributes), to_sesno 0 if it still holds."""
    order = Window.partitionBy(*ELEMENT, "satellite").orderBy("sesno")
    ended = appended.withColumn("to_sesno", F.coalesce(F.lead("sesno").over(order), F.lit(0)))
    return ended.where(~F.col("removed")).select(*ELEMENT, "satellite", "hash", F.col("sesno").alias("from_sesno"), "to_sesno", "attributes")


def element_periods(appended: DataFrame) -> DataFrame:
    """The view over both satellites: (ELEMENT, from_sesno, to_sesno), a row per period with the same attributes."""
    points = appended.groupBy(*VERSION).agg(F.max("removed").alias("removed"))
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    ended = points.withColumn("to_sesno", F.coalesce(F.lead("sesno").over(order), F.lit(0)))
    return ended.where(~F.col("removed")).select(*ELEMENT, F.col("sesno").alias("from_sesno"), "to_sesno")


def attributes_as_of(appended: DataFrame, sesno: int) -> DataFrame:
    """(ELEMENT, key, value, since): the attributes that elements had after a session, from the satellites alone; since is the satellite row's session."""
    last = appended.where(F.col("sesno") <= sesno).groupBy(*ELEMENT, "satellite").agg(F.max_by(F.struct("sesno", "removed", "attributes"), "sesno").alias("x"))
    return last.where("not x.removed").select(*ELEMENT, F.col("x.sesno").alias("since"), F.explode("x.attributes").alias("a")).select(*ELEMENT, "a.key", "a.value", "since")
