"""Analytics over the change log and the stores: counts by day and session, paging, histograms, consistency checks.

Every function is one pass with map-side aggregation; conditional counts replace one query per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elemlake.operators.change_feed import operation

KINDS = ("add", "modify", "delete", "none")


def once(changes: DataFrame) -> DataFrame:
    """Each operation once, with its kind; ts is the earliest delivery's."""
    kind = operation(F.col("operation_type"))
    rows = changes.select("dbnum", "ref0", "ref1", "sesno", "op_no", kind.alias("kind"), "entity_type", "ts")
    return rows.groupBy("dbnum", "ref0", "ref1", "sesno", "op_no").agg(F.min("kind").alias("kind"), F.max("entity_type").alias("entity_type"), F.min("ts").alias("ts"))


def counts_by_kind() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]


def daily_counts(changes: DataFrame) -> DataFrame:
    """(day, n): operations per day."""
    return once(changes).where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def daily_operations(changes: DataFrame) -> DataFrame:
    """(day, n_add, n_modify, n_delete, n_none)"""
    return once(changes).where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(*counts_by_kind())


def overview(changes: DataFrame, day: str) -> DataFrame:
    """Counts by kind of a day and the day before, and all elements ever changed, in one scan. The day is a parameter, not the clock."""
    today = F.to_date("ts") == F.to_date(F.lit(day))
    yesterday = F.to_date("ts") == F.date_sub(F.to_date(F.lit(day)), 1)
    counts = [F.count_if(when & (F.col("kind") == k)).alias(f"{name}_{k}") for name, when in (("today", today), ("yesterday", yesterday)) for k in KINDS]
    return once(changes).agg(*counts, F.countDistinct("dbnum", "ref0", "ref1").alias("n_elements"))


def day_page(changes: DataFrame, day: str, days: int, limit: int, start: int) -> DataFrame:
    """A page of the change log in a half-open range of days, newest first; the key breaks ties, so pages don't overlap."""
    low = F.to_timestamp(F.lit(day))
    rows = once(changes).where((F.col("ts") >= low) & (F.col("ts") < low + F.make_interval(days=F.lit(days))))
    return rows.orderBy(F.desc("ts"), "dbnum", "sesno", "op_no").offset(start).limit(limit)


def operations_by_session(changes: DataFrame) -> DataFrame:
    """(dbnum, sesno, n_add, n_modify, n_delete, n_none)"""
    return once(changes).groupBy("dbnum", "sesno").agg(*counts_by_kind())


def with_sessions(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Operations with their session's computer and comment, where there is one."""
    from elemlake.operators.lookup import sessions_once

    names = sessions_once(sessions).select("dbnum", "sesno", "computer_name", "comments")
    return once(changes).join(names, ["dbnum", "sesno"], "left")


def coverage(changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per database: sessions, sessions with operations, operations by kind, elements, and elements changed more than once."""
    per_element = once(changes).groupBy("dbnum", "ref0", "ref1").agg(F.count(F.lit(1)).alias("n"), *counts_by_kind())
    elements = per_element.groupBy("dbnum").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS], F.count(F.lit(1)).alias("n_elements"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    covered = changes.groupBy("dbnum").agg(F.countDistinct("sesno").alias("n_covered"))
    all_ = sessions.groupBy("dbnum").agg(F.countDistinct("sesno").alias("n_sessions"))
    return all_.join(covered, "dbnum", "left").join(elements, "dbnum", "left").select("dbnum", "n_sessions", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_covered", *[f"n_{k}" for k in KINDS], "n_elements", "n_repeated")])


def type_histogram(layout: DataFrame) -> DataFrame:
    """(attr_type, n, n_expressions) of the layout, most frequent first."""
    return layout.groupBy("attr_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_expr").alias("n_expressions")).orderBy(F.desc("n"), "attr_type")


def noun_attributes(layout: DataFrame) -> DataFrame:
    """(noun, attrs): each noun's attributes, sorted."""
    return layout.groupBy("noun").agg(F.array_sort(F.collect_set("attr")).alias("attrs"))


def noun_elements(versions: DataFrame) -> DataFrame:
    """(dbnum, noun, n_elements): how many elements ever had a noun. The set itself is unbounded and stays distributed."""
    return versions.groupBy("dbnum", "noun", "ref0", "ref1").agg(F.lit(1)).groupBy("dbnum", "noun").agg(F.count(F.lit(1)).alias("n_elements"))


def attribute_profile(attrs: DataFrame) -> DataFrame:
    """Per attribute: rows, unset rows, tags and kinds it comes with (both from short fixed lists)."""
    unset = " and ".join(f"{c} is null" for c in ("v_int", "v_double", "v_bool", "v_str", "v_ints", "v_doubles", "v_strs", "v_refs"))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return attrs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(unset)).alias("n_unset"), join("tag").alias("tags"), join("kind").alias("kinds"))


def contiguity(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, n, contiguous): whether the numbers of a group run from 0 or 1 without gap or repetition; aggregates only, no sort."""
    n = F.countDistinct(number)
    return rows.groupBy(*keys).agg(F.count(number).alias("n"), (F.min(number).isin(0, 1) & (F.max(number) - F.min(number) + 1 == n) & (n == F.count(number))).alias("contiguous"))


def session_summary(sessions: DataFrame) -> DataFrame:
    """Per database: number and newest session, its date as timestamp and in Unix seconds, highest page."""
    newest = F.max_by("ts", "sesno")
    return sessions.groupBy("dbnum").agg(F.countDistinct("sesno").alias("n_sessions"), F.max("sesno").alias("last_sesno"), newest.alias("last_ts"), F.unix_timestamp(newest).alias("last_unix"), F.max("end_pgno").alias("max_pgno"))


def sessions_between(sessions: DataFrame, low: str, high: str) -> DataFrame:
    """(dbnum, sesno, ts) dated in the closed range, oldest first."""
    at = F.col("ts").between(F.to_timestamp(F.lit(low)), F.to_timestamp(F.lit(high)))
    return sessions.where(at).select("dbnum", "sesno", "ts").distinct().orderBy("ts", "dbnum", "sesno")


# The four rules for a session row.
SESSION_RULES = {
    "sesno": "sesno is null or sesno <= 0",
    "pages": "end_pgno is null or end_pgno <= 0 or end_pgno < ses_pgno",
    "chain": "prev_ses_pgno >= ses_pgno",
    "index": "index_root_pgno is null or index_root_pgno <= 0",
}


def session_violations(sessions: DataFrame) -> DataFrame:
    """(dbnum, sesno, rule): a row per broken rule."""
    broken = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in SESSION_RULES.items()]))
    return sessions.select("dbnum", "sesno", F.explode(broken).alias("rule")).distinct()
