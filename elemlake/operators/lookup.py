"""Point, as-of and history lookups, expressed as joins and windows over version rows.

A window over one element holds at most one row per session of its database.
Windows over a whole database are cut into blocks (plans.skew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENT = ["dbnum", "ref0", "ref1"]
VERSION = [*ELEMENT, "sesno"]

# The index start marker in both words, the page size of the stores, and the sizes that are probed.
START_MARKER = 0x80000001
PAGE_SIZE = 2048
PAGE_SIZES = (2048, 4096, 512)


def standing(versions: DataFrame) -> DataFrame:
    """One row per (element, session): the version with the largest byte_offset (at a tie a removal)."""
    row = F.struct("byte_offset", F.coalesce("deleted", F.lit(False)).alias("deleted"), "noun", "owner_ref0", "owner_ref1", "name", "children")
    return versions.groupBy(*VERSION).agg(F.max(row).alias("v")).select(*VERSION, "v.*")


def latest(versions: DataFrame, upto: Column | None = None) -> DataFrame:
    """The newest version of every element, at or before a session if a condition says so."""
    rows = versions if upto is None else versions.where(upto)
    row = F.struct("sesno", "byte_offset", F.coalesce("deleted", F.lit(False)).alias("deleted"), "noun", "owner_ref0", "owner_ref1", "name", "children")
    return rows.groupBy(*ELEMENT).agg(F.max(row).alias("v")).select(*ELEMENT, "v.*")


def existing(versions: DataFrame, upto: Column | None = None) -> DataFrame:
    """The newest versions that are not removals (soft delete)."""
    return latest(versions, upto).where("not deleted")


def latest_and_previous(versions: DataFrame) -> DataFrame:
    """(ELEMENT, sesno, prev_sesno, byte_offset, prev_byte_offset): the two newest versions."""
    sessions = standing(versions.select(*VERSION, "byte_offset", "deleted", "noun", "owner_ref0", "owner_ref1", "name", "children")).select(*VERSION, "byte_offset")
    newest_first = Window.partitionBy(*ELEMENT).orderBy(F.desc("sesno"))
    ranked = sessions.select("*", F.row_number().over(newest_first).alias("n"), F.lead("sesno").over(newest_first).alias("prev_sesno"), F.lead("byte_offset").over(newest_first).alias("prev_byte_offset"))
    return ranked.where("n = 1").drop("n")


def history(versions: DataFrame) -> DataFrame:
    """(VERSION, byte_offset, k): all versions, k = 0 for the newest."""
    newest_first = Window.partitionBy(*ELEMENT).orderBy(F.desc("sesno"))
    return standing(versions).select(*VERSION, "byte_offset", "deleted", "noun", (F.row_number().over(newest_first) - 1).alias("k"))


def history_labels(versions: DataFrame) -> DataFrame:
    """History with operation labels: the oldest version is an Add, the others are Modified; the newest is the element itself and is left out."""
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    newest = Window.partitionBy(*ELEMENT)
    rows = standing(versions).select(*VERSION, F.row_number().over(order).alias("n"), F.max("sesno").over(newest).alias("last"))
    return rows.where("sesno < last").select(*VERSION, F.when(F.col("n") == 1, "Add").otherwise("Modified").alias("operation"))


def sessions_once(sessions: DataFrame) -> DataFrame:
    """One row per (dbnum, sesno), whatever is delivered twice."""
    rest = [c for c in sessions.columns if c not in ("dbnum", "sesno")]
    return sessions.where("dbnum is not null and sesno is not null").groupBy("dbnum", "sesno").agg(F.max(F.struct(*rest)).alias("s")).select("dbnum", "sesno", "s.*")


def session_ranges(sessions: DataFrame) -> DataFrame:
    """Sessions with the pages they wrote: from the page after the last session's end to their own end, both inclusive."""
    order = Window.partitionBy("dbnum").orderBy("sesno")  # at most the sessions of one database
    return sessions_once(sessions).withColumn("prev_end_pgno", F.lag("end_pgno").over(order)).withColumn("first_pgno", F.coalesce(F.col("prev_end_pgno") + 1, F.lit(0)))


def session_of_pages(pages: DataFrame, sessions: DataFrame, page: str, bits: int = 8) -> DataFrame:
    """pages with page_sesno, the session whose page range holds the page.

    A range join as an equi join: ranges are cut at multiples of 2^bits pages, so neither side meets more than one block's rows.
    """
    ranges = session_ranges(sessions).where("first_pgno <= end_pgno")
    cut = ranges.select("dbnum", F.col("sesno").alias("page_sesno"), "first_pgno", "end_pgno", F.explode(F.sequence(F.shiftright("first_pgno", bits), F.shiftright("end_pgno", bits))).alias("page_block"))
    # The exchange by the join's keys shows how many pieces there are, which Spark would take for the sessions they come from, before anything is broadcast.
    cut = cut.repartition("dbnum", "page_block")
    left = pages.withColumn("page_block", F.shiftright(page, bits)).alias("l")
    inside = (F.col("l.dbnum") == F.col("r.dbnum")) & (F.col("l.page_block") == F.col("r.page_block")) & F.col(page).between(F.col("r.first_pgno"), F.col("r.end_pgno"))
    return left.join(cut.alias("r"), inside, "left").select(*[F.col(f"l.{c}") for c in pages.columns], "page_sesno")


def nearest_sessions(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """asked (dbnum, sesno) with the largest session below and the smallest at or above each: as-of in one window.

    asked is reduced to distinct rows, so a window holds at most twice the sessions of a database.
    """
    known = sessions_once(sessions).select("dbnum", "sesno", F.col("sesno").alias("s"), F.lit(0).alias("side"))
    wanted = asked.select("dbnum", "sesno").where("sesno is not null").distinct().select("dbnum", "sesno", F.lit(None).cast("int").alias("s"), F.lit(1).alias("side"))
    order = Window.partitionBy("dbnum").orderBy("sesno")
    both = known.unionByName(wanted).select(
        "dbnum", "sesno", "side",
        F.last("s", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, -1)).alias("less_sesno"),
        F.first("s", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("large_sesno"),
    )
    return both.where("side = 1").drop("side")


def as_of_time(versions: DataFrame, sessions: DataFrame, moment: str) -> DataFrame:
    """Existing elements at a moment: the newest version whose session is dated at or before it."""
    dated = sessions_once(sessions).where(F.col("ts") <= F.to_timestamp(F.lit(moment))).select("dbnum", "sesno")
    return existing(versions.join(dated, ["dbnum", "sesno"], "left_semi"))


def valid_entries(index_entries: DataFrame) -> DataFrame:
    """Leaf entries that point to a record, with its byte address."""
    rows = index_entries.where(f"level = 0 and not (ref0 = 0 and ref1 = 0) and not (ref0 = {START_MARKER} and ref1 = {START_MARKER}) and child_pgno != 0 and offset_words != 0")
    return rows.withColumn("address", F.col("child_pgno") * PAGE_SIZE + F.col("offset_words") * 2)


def index_map(index_entries: DataFrame) -> DataFrame:
    """(ELEMENT, addresses): the distinct addresses of every element, ascending; the last is the newest."""
    return valid_entries(index_entries).groupBy(*ELEMENT).agg(F.array_sort(F.collect_set("address")).alias("addresses"))


def index_version(index_entries: DataFrame, k: int) -> DataFrame:
    """(ELEMENT, address) of the k-th newest address; elements with fewer are left out."""
    return index_map(index_entries).where(F.size("addresses") > k).select(*ELEMENT, F.element_at("addresses", -1 - k).alias("address"))


def known_children(versions: DataFrame) -> DataFrame:
    """(ELEMENT, child_ref0, child_ref1, ord) of existing elements, only children that exist; ord is the place in the list."""
    now = existing(versions)
    edges = now.select(*ELEMENT, F.posexplode("children").alias("ord", "c")).select(*ELEMENT, "ord", F.col("c.ref0").alias("child_ref0"), F.col("c.ref1").alias("child_ref1"))
    known = now.select("dbnum", F.col("ref0").alias("child_ref0"), F.col("ref1").alias("child_ref1"))
    return edges.join(known, ["dbnum", "child_ref0", "child_ref1"], "left_semi").select(*ELEMENT, "child_ref0", "child_ref1", "ord")


def not_listed_by_owner(versions: DataFrame) -> DataFrame:
    """Existing elements with an existing owner that does not list them."""
    now = existing(versions)
    listed = now.select("dbnum", F.col("ref0").alias("owner_ref0"), F.col("ref1").alias("owner_ref1"), F.explode("children").alias("c")).select("dbnum", "owner_ref0", "owner_ref1", F.col("c.ref0").alias("ref0"), F.col("c.ref1").alias("ref1"))
    owners = now.select("dbnum", F.col("ref0").alias("owner_ref0"), F.col("ref1").alias("owner_ref1"))
    owned = now.join(owners, ["dbnum", "owner_ref0", "owner_ref1"], "left_semi").select(*ELEMENT, "owner_ref0", "owner_ref1")
    return owned.join(listed, [*ELEMENT, "owner_ref0", "owner_ref1"], "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sources by key: (keys, left_value, right_value, outcome): matched, mismatched, left_only or right_only."""
    l = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    r = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    outcome = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "matched").otherwise("mismatched")
    return l.join(r, keys, "full").select(*keys, "left_value", "right_value", outcome.alias("outcome"))


def record_lengths(versions: DataFrame, bits: int = 16) -> DataFrame:
    """(dbnum, byte_offset, next_offset): where each record ends, by the start of the next; blocks of 2^bits bytes keep windows small."""
    starts = versions.where("byte_offset is not null").select("dbnum", "byte_offset", F.shiftright("byte_offset", bits).alias("block")).distinct()
    inside = Window.partitionBy("dbnum", "block").orderBy("byte_offset")
    # One row per block goes into the window over a whole database.
    firsts = starts.groupBy("dbnum", "block").agg(F.min("byte_offset").alias("first"))
    following = firsts.withColumn("next_first", F.lead("first").over(Window.partitionBy("dbnum").orderBy("block"))).drop("first")
    return starts.withColumn("next_in", F.lead("byte_offset").over(inside)).join(following, ["dbnum", "block"]).select("dbnum", "byte_offset", F.coalesce("next_in", "next_first").alias("next_offset"))


def resolve_versions(asked: DataFrame, versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """asked (ELEMENT, s, s_db) with the session whose version is meant, and whether it is the newest.

    With s and s_db: the newest version dated at or before session s of
    database s_db. With s alone: the newest version at or before s. Without
    s: the newest. Elements without such a version have null.
    """
    dated = sessions_once(sessions)
    moments = dated.select(F.col("dbnum").alias("s_db"), F.col("sesno").alias("s"), F.col("ts").alias("moment"))
    own = standing(versions).select(*VERSION).join(dated.select("dbnum", "sesno", "ts"), ["dbnum", "sesno"], "left")
    newest = own.groupBy(*ELEMENT).agg(F.max("sesno").alias("newest"))
    rows = asked.join(moments, ["s_db", "s"], "left").join(own, ELEMENT, "left")
    fits = F.when(F.col("s").isNotNull() & F.col("s_db").isNotNull(), F.col("ts") <= F.col("moment")).when(F.col("s").isNotNull(), F.col("sesno") <= F.col("s")).otherwise(F.lit(True))
    found = rows.groupBy(*ELEMENT, "s", "s_db").agg(F.max(F.when(fits, F.col("sesno"))).alias("sesno"))
    return found.join(newest, ELEMENT, "left").select(*ELEMENT, "s", "s_db", "sesno", F.coalesce(F.col("sesno") == F.col("newest"), F.lit(False)).alias("is_latest"))


def database_names(files: DataFrame, by_number: DataFrame, by_field: DataFrame) -> DataFrame:
    """files (path, dbnum, field_no) with a name: by database number, else by field number, else the file's own."""
    names = by_number.select("dbnum", F.col("name").alias("_n")).dropDuplicates(["dbnum"])
    fields = by_field.select("field_no", F.col("name").alias("_f")).dropDuplicates(["field_no"])
    own = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.join(names, "dbnum", "left").join(fields, "field_no", "left").select(*files.columns, F.coalesce("_n", "_f", own).alias("name"))


def slot_lengths(offsets: DataFrame, group: list[str], offset: str, total: str) -> DataFrame:
    """offsets with the length of each slot: up to the next offset of its group, or to the group's total. A group is one index page."""
    following = F.lead(offset).over(Window.partitionBy(*group).orderBy(offset))
    return offsets.withColumn("length", F.coalesce(following, F.col(total)) - F.col(offset))
