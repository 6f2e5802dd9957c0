"""What changed between full snapshots, with a bucketed key-to-hash index.

The index is a table of its own, bucketed by record key: the hash of every
record as of the last snapshot, and the snapshot in which its values were
written. The next snapshot's keys and hashes probe it inside the buckets,
without an exchange. Values are written only where the probe finds a record
new or changed, so old values are fetched for changed keys only, from
the snapshot the index names. What the probe writes is the index for the
snapshot after: the swap is a change of names.

Defined results: of the rows of one record in one snapshot the latest
captured_at stands (null is earliest; at a tie the greatest text, so repeated
rows change nothing); a null or unreadable map is an empty map; rows without
dbnum, ses_no, ref0 or ref1 name no record and take no part; a database's
first snapshot is compared with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.values import map_entries_of_json
from elemlake.plans.workspace import bucketed, release, written

KEY = ["dbnum", "ref0", "ref1"]
CHANGES = "dbnum int, ses_no int, ref0 bigint, ref1 bigint, diff_type string, attr string, old_value string, new_value string"


@dataclass
class SnapshotIndex:
    """What is kept between deliveries: tables written by probes, the newest last.

    Each has (KEY, ses_no, hash, value_ses, diff_type, old_ses, entries). The newest is the index: rows with a hash are the
    records that exist, value_ses the snapshot that wrote their values. entries is filled only for records that
    were new or changed in their table, so all tables together hold every value once.
    """

    tables: list[DataFrame]
    buckets: int | None = None

    @property
    def records(self) -> DataFrame:
        return self.tables[-1].where("hash is not null").select(*KEY, "hash", "value_ses")

    @property
    def values(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.where("entries is not null").select(*KEY, "value_ses", "entries") for t in self.tables])


def standing_rows(snapshots: DataFrame) -> DataFrame:
    """(KEY, ses_no, whole_attmap): one row per record and snapshot."""
    named = snapshots.where(" and ".join(f"{c} is not null" for c in [*KEY, "ses_no"]))
    latest = named.groupBy(*KEY, "ses_no").agg(F.max(F.struct("captured_at", "whole_attmap")).alias("row"))
    return latest.select(*KEY, "ses_no", "row.whole_attmap")


def series_of(snapshots: DataFrame) -> DataFrame:
    """(dbnum, ses_no, step): the snapshots of every database, numbered; a row per delivery, not per record."""
    listed = snapshots.where(" and ".join(f"{c} is not null" for c in [*KEY, "ses_no"])).select("dbnum", "ses_no").distinct()
    return listed.withColumn("step", F.row_number().over(Window.partitionBy("dbnum").orderBy("ses_no")))


def probe(records: DataFrame | None, fresh: DataFrame, delivered: DataFrame, keep_others: bool) -> DataFrame:
    """The rows of the next index table. fresh is a snapshot (KEY, ses_no, whole_attmap) bucketed as the index is; delivered is (dbnum, due) of its databases.

    keep_others keeps the records of databases that are not in this delivery as they are.
    """
    new = fresh.select(*KEY, F.col("ses_no").alias("new_ses"), map_entries_of_json("whole_attmap").alias("new_entries")).withColumn("new_hash", F.xxhash64("new_entries"))
    none = F.lit(None)
    if records is None:
        return new.select(*KEY, F.col("new_ses").alias("ses_no"), F.col("new_hash").alias("hash"), F.col("new_ses").alias("value_ses"), none.cast("string").alias("diff_type"), none.cast("int").alias("old_ses"), F.col("new_entries").alias("entries"))
    old = records.select(*KEY, F.col("hash").alias("old_hash"), F.col("value_ses").alias("old_ses")).join(delivered, "dbnum", "left" if keep_others else "inner")
    known = records.select("dbnum").distinct().withColumn("known", F.lit(True)) if keep_others else None
    if known is not None:
        new = new.join(known, "dbnum", "left")
    both = old.join(new, KEY, "full")
    is_known = F.col("known").isNotNull() if keep_others else F.lit(True)
    was, has = F.col("old_hash").isNotNull(), F.col("new_hash").isNotNull()
    kind = (
        F.when(was & ~has, F.when(F.col("due").isNotNull(), F.lit("removed")))
        .when(~was & has, F.when(is_known, F.lit("added")))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
    )
    moved = has & (~was | (F.col("old_hash") != F.col("new_hash")))
    gone = F.coalesce(kind == "removed", F.lit(False))
    return both.select(
        *KEY, F.coalesce("new_ses", "due").alias("ses_no"), F.when(~gone, F.coalesce("new_hash", "old_hash")).alias("hash"), F.when(moved, F.col("new_ses")).when(~gone, F.col("old_ses")).alias("value_ses"),
        kind.alias("diff_type"), F.when(kind == "changed", F.col("old_ses")).alias("old_ses"), F.when(moved, F.col("new_entries")).alias("entries"),
    )


def attribute_changes(changed: DataFrame, values: DataFrame) -> DataFrame:
    """The old and new values of changed keys, an attribute a row: (KEY, ses_no, attr, old_value, new_value). Only old values are looked up."""
    old = values.select(*KEY, F.col("value_ses").alias("old_ses"), F.col("entries").alias("old"))
    gone = F.expr("transform(array_except(old, new), e -> struct(e.key as attr, e.value as value, 0 as side))")
    come = F.expr("transform(array_except(new, old), e -> struct(e.key as attr, e.value as value, 1 as side))")
    both = changed.withColumnRenamed("entries", "new").join(old, [*KEY, "old_ses"]).select(*KEY, "ses_no", F.concat(gone, come).alias("sides"))
    attrs = F.expr("transform(array_distinct(transform(sides, s -> s.attr)), a -> struct(a as attr, get(filter(sides, s -> s.attr = a and s.side = 0), 0).value as old_value, get(filter(sides, s -> s.attr = a and s.side = 1), 0).value as new_value))")
    return both.select(*KEY, "ses_no", F.explode(attrs).alias("a")).select(*KEY, "ses_no", "a.*")


def changes_of(moves: DataFrame, values: DataFrame) -> DataFrame:
    """All changes that index rows tell, with the values on both sides."""
    nothing = F.lit(None).cast("string")
    whole = moves.where("diff_type in ('added', 'removed')").select("dbnum", "ses_no", "ref0", "ref1", "diff_type", F.lit("").alias("attr"), nothing.alias("old_value"), nothing.alias("new_value"))
    found = attribute_changes(moves.where("diff_type = 'changed'").select(*KEY, "ses_no", "old_ses", "entries"), values)
    return whole.unionByName(found.select("dbnum", "ses_no", "ref0", "ref1", F.lit("changed").alias("diff_type"), "attr", "old_value", "new_value"))


def apply_snapshot(index: SnapshotIndex | None, snapshots: DataFrame, buckets: int | None = None) -> tuple[DataFrame, SnapshotIndex]:
    """(changes, index after): one further snapshot of any number of databases; of one database's several, or of one that is older than the index, the caller makes several calls in order."""
    buckets = index.buckets if index else buckets
    fresh = bucketed(standing_rows(snapshots), "snapshot", KEY, buckets=buckets)
    delivered = fresh.groupBy("dbnum").agg(F.max("ses_no").alias("due"))
    if index is None:
        first = bucketed(probe(None, fresh, delivered, True), "snapshot-index", KEY, buckets=buckets, placed=True)
        release(fresh)
        return snapshots.sparkSession.createDataFrame([], CHANGES), SnapshotIndex([first], buckets)
    table = bucketed(probe(index.records, fresh, delivered, True), "snapshot-index", KEY, buckets=buckets, placed=True)
    release(fresh)
    return changes_of(table.where("diff_type is not null"), index.values), SnapshotIndex([*index.tables, table], buckets)


def compact(index: SnapshotIndex) -> SnapshotIndex:
    """An index of one table: the records that exist, with their values. After many deliveries it keeps plans short and leaves superseded values behind.

    The old tables stay for the changes that were told from them; release() deletes them once those are written.
    """
    live = index.tables[-1].where("hash is not null").select(*KEY, "ses_no", "hash", "value_ses")
    rows = live.join(index.values, [*KEY, "value_ses"])
    table = rows.select(*KEY, "ses_no", "hash", "value_ses", F.lit(None).cast("string").alias("diff_type"), F.lit(None).cast("int").alias("old_ses"), "entries")
    return SnapshotIndex([bucketed(table, "snapshot-index", KEY, buckets=index.buckets)], index.buckets)


def snapshot_changes(snapshots: DataFrame, buckets: int | None = None, steps_per_plan: int = 12) -> DataFrame:
    """All changes between consecutive snapshots: (dbnum, ses_no, ref0, ref1, diff_type, attr, old_value, new_value).

    Every step takes the next snapshot of all databases that have one. What probes found is read at the end, of long
    series steps_per_plan tables at a time, so that no plan grows with the series.
    """
    series = written(series_of(snapshots), "snapshot-series")
    steps = series.agg(F.max("step")).first()[0] or 0
    store = bucketed(standing_rows(snapshots).join(series, ["dbnum", "ses_no"]), "snapshots", KEY, partition_by=["step"], buckets=buckets)
    index = SnapshotIndex([], buckets)
    for step in range(1, max(steps, 1) + 1):
        delivered = series.where(F.col("step") == step).select("dbnum", F.col("ses_no").alias("due"))
        rows = probe(index.records if index.tables else None, store.where(F.col("step") == step), delivered, False)
        index.tables.append(bucketed(rows, "snapshot-index", KEY, buckets=buckets, placed=True))
    release(store)
    later = index.tables[1:] or [index.tables[0].where("false")]
    lots = [reduce(DataFrame.unionByName, later[i : i + steps_per_plan]).where("diff_type is not null") for i in range(0, len(later), steps_per_plan)]
    values = index.values if len(lots) == 1 else written(index.values, "snapshot-values")
    found = [changes_of(lot, values) for lot in lots]
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, [written(x, "snapshot-changes") for x in found])
