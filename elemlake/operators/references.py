"""References to records that do not exist.

Parent keys are compressed into contiguous runs of (ref0, ref1) with ref1
rising by one; runs are cut at multiples of the key block, so a key and the
start of its run always lie in the same block. References are matched as-of:
to the last run start at or before them, inside their block. A reference
beyond that run's end names a key that never existed. The others are
matched as-of to their target's versions by session, which tells removed
and not yet created targets from existing ones.

Defined results: a null or (0, 0) reference and the index start marker are no
references; rows without dbnum or session are no rows of a period and take no part; of
the versions of one element and session the one with the largest byte_offset
stands (at a tie a removal); repeated rows change nothing; without versions
every reference is missing.

Group sizes: references are reduced to distinct (dbnum, target, session)
before any window, so a window holds at most the keys of one block times the
sessions of one database, however many rows name one target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.workspace import written

#: Keys of one block, as a power of two.
BLOCK_BITS = 12
START_MARKER = 0x80000001  # in both words


def standing_versions(versions: DataFrame) -> DataFrame:
    named = versions.where("dbnum is not null and ref0 is not null and ref1 is not null and sesno is not null")
    row = F.struct("byte_offset", F.coalesce("deleted", F.lit(False)).alias("deleted"), "owner_ref0", "owner_ref1", "children")
    return named.groupBy("dbnum", "ref0", "ref1", "sesno").agg(F.max(row).alias("v")).select("dbnum", "ref0", "ref1", "sesno", "v.deleted", "v.owner_ref0", "v.owner_ref1", "v.children")


def references(versions: DataFrame, index_entries: DataFrame) -> DataFrame:
    """All references: (ref_field, dbnum, sesno, ref0, ref1, target_ref0, target_ref1). versions are standing ones."""
    live = versions.where("not deleted")
    own = ["dbnum", "sesno", "ref0", "ref1"]
    owner = live.select(F.lit("owner").alias("ref_field"), *own, F.col("owner_ref0").alias("target_ref0"), F.col("owner_ref1").alias("target_ref1"))
    children = live.select(*own, F.explode("children").alias("c")).select(F.lit("children").alias("ref_field"), *own, F.col("c.ref0").alias("target_ref0"), F.col("c.ref1").alias("target_ref1"))
    index = index_entries.where("level = 0 and dbnum is not null and sesno is not null").select(F.lit("index").alias("ref_field"), *own, F.col("ref0").alias("target_ref0"), F.col("ref1").alias("target_ref1"))
    none = "target_ref0 is null or target_ref1 is null or (target_ref0 = 0 and target_ref1 = 0)"
    marker = f"(target_ref0 = {START_MARKER} and target_ref1 = {START_MARKER})"
    return owner.unionByName(children).unionByName(index).where(f"not ({none}) and not {marker}")


def contiguous_runs(keys: DataFrame, group: list[str], key: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct integer keys as runs: (group, block, run_start, run_end)."""
    distinct = keys.select(*group, F.shiftright(key, bits).alias("block"), F.col(key).alias("k")).distinct()
    inside = Window.partitionBy(*group, "block").orderBy("k")
    return distinct.withColumn("run", F.col("k") - F.row_number().over(inside)).groupBy(*group, "block", "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("run")


def in_runs(refs: DataFrame, runs: DataFrame, group: list[str], key: str, bits: int = BLOCK_BITS) -> DataFrame:
    """refs with ``in_run``: whether the run with the last start at or before the key reaches it. refs and runs meet in one window, not in a join."""
    columns = refs.columns
    left = refs.select("*", F.shiftright(key, bits).alias("block"), F.col(key).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("run_end"))
    right = runs.select(*group, "block", F.col("run_start").alias("_at"), F.lit(0).alias("_side"), "run_end")
    upto = Window.partitionBy(*group, "block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_end", F.last("run_end", ignorenulls=True).over(upto))
    return both.where("_side = 1").select(*columns, F.coalesce(F.col("_at") <= F.col("_end"), F.lit(False)).alias("in_run"))


def absences(targets: DataFrame, versions: DataFrame) -> DataFrame:
    """Distinct (dbnum, sesno, target_ref0, target_ref1) that do not exist at their session, with miss_kind."""
    group = ["dbnum", "target_ref0"]
    keys = versions.select("dbnum", F.col("ref0").alias("target_ref0"), F.col("ref1").alias("target_ref1"), "sesno", "deleted")
    runs = contiguous_runs(keys, group, "target_ref1")
    matched = in_runs(targets.distinct(), runs, group, "target_ref1")
    columns = ["dbnum", "sesno", "target_ref0", "target_ref1"]
    missing = matched.where("not in_run").select(*columns, F.lit("missing").alias("miss_kind"))

    asked = matched.where("in_run").select(*columns, F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("deleted"))
    states = keys.select(*columns, F.lit(0).alias("_side"), "deleted")
    upto = Window.partitionBy("dbnum", "target_ref0", "target_ref1").orderBy("sesno", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(states).withColumn("gone", F.last("deleted", ignorenulls=True).over(upto)).where("_side = 1 and (gone is null or gone)")
    dated = seen.select(*columns, F.when(F.col("gone").isNull(), "later").otherwise("deleted").alias("miss_kind"))
    return missing.unionByName(dated)


def orphan_references(versions: DataFrame, index_entries: DataFrame) -> DataFrame:
    """Every reference whose target does not exist at the row's session, with the kind of absence; repeated references once."""
    # Reduced once: references read owners and children of it, runs and states only keys.
    standing = written(standing_versions(versions), "standing-versions")
    refs = references(standing, index_entries)
    gone = absences(refs.select("dbnum", "sesno", "target_ref0", "target_ref1"), standing)
    found = refs.join(gone, ["dbnum", "sesno", "target_ref0", "target_ref1"])
    return found.select("ref_field", "dbnum", "sesno", "ref0", "ref1", "target_ref0", "target_ref1", "miss_kind").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per field, database, session and kind of absence."""
    return orphans.groupBy("ref_field", "dbnum", "sesno", "miss_kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_ref0", "target_ref1").alias("n_targets"))
