"""Change capture over element versions: what each session did to each element.

Content is compared through per-attribute hashes (elemlake.operators.satellites
canonicalises the values), so attribute payloads are never shuffled twice.
Windows over one element hold at most one row per session of its database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elemlake.operators.lookup import ELEMENT, VERSION, existing, session_ranges, standing
from elemlake.operators.satellites import value_text
from elemlake.plans.values import BOOKKEEPING


def touched_entries(index_entries: DataFrame, sessions: DataFrame, include_initial: bool = False) -> DataFrame:
    """(VERSION) the index says a session touched: flagged entries whose page lies strictly between the last session's end and its own.

    Both bounds are exclusive, and a database's first session yields nothing unless asked for.
    """
    ranges = session_ranges(sessions).select("dbnum", "sesno", "end_pgno", F.coalesce("prev_end_pgno", F.lit(-1).cast("bigint") if include_initial else F.lit(None).cast("bigint")).alias("after"))
    rows = index_entries.where("flag = 1").join(ranges, ["dbnum", "sesno"]).where("child_pgno > after and child_pgno < end_pgno")
    return rows.select(*VERSION).distinct()


def touched_versions(versions: DataFrame, index_entries: DataFrame, sessions: DataFrame) -> DataFrame:
    """The standing versions that touched_entries() names; entries without a version of their session have none to show."""
    return standing(versions).join(touched_entries(index_entries, sessions), VERSION, "left_semi")


def attribute_hashes(attrs: DataFrame, ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """(VERSION, kind, key, h): one row per set attribute of a version."""
    value = value_text()
    rows = attrs.where(~F.col("key").isin(*ignore)) if ignore else attrs
    return rows.where(value.isNotNull()).groupBy(*VERSION, "kind", "key").agg(F.max(F.xxhash64(value)).alias("h"))


def content_hashes(versions: DataFrame, attrs: DataFrame, ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """standing versions with ``content``: a hash of noun, owner, name, children in order and all attributes but the ignored ones."""
    per_version = attribute_hashes(attrs, ignore).groupBy(*VERSION).agg(F.array_sort(F.collect_set(F.xxhash64("kind", "key", "h"))).alias("a"))
    rows = standing(versions).join(per_version, VERSION, "left")
    # xxhash64 passes over nulls, so which fields are null is hashed as well; no children and an empty list are the same.
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in ("noun", "owner_ref0", "owner_ref1", "name")])
    return rows.withColumn("content", F.xxhash64(nulls, "noun", "owner_ref0", "owner_ref1", "name", "children", "a")).drop("a")


def without_repeats(versions: DataFrame, attrs: DataFrame, ignore: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    """Versions whose content differs from the version before; removals always stay and reset."""
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    marked = content_hashes(versions, attrs, ignore).withColumn("_c", F.when(~F.col("deleted"), F.col("content"))).withColumn("_before", F.lag("_c").over(order))
    return marked.where("deleted or _before is null or _c != _before").drop("_c", "_before")


def _pairs(versions: DataFrame) -> DataFrame:
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    fields = ["sesno", "noun", "owner_ref0", "owner_ref1", "name", "children", "deleted"]
    return standing(versions).withColumn("prev", F.lag(F.struct(*fields)).over(order))


def attribute_deltas(versions: DataFrame, attrs: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(VERSION, kind, key, change): attributes added, deleted or modified against the element's version before.

    Found by one window per (element, attribute) instead of a join of neighbouring maps: each attribute row knows which session follows it.
    """
    return _deltas(_neighbours(standing(versions)), attrs, ignore)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Versions that are not removals, with the sessions of those before and after; what standing versions have besides stays."""
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    return rows.where("not deleted").withColumn("prev_sesno", F.lag("sesno").over(order)).withColumn("next_sesno", F.lead("sesno").over(order))


def _deltas(neighbours: DataFrame, attrs: DataFrame, ignore: tuple[str, ...]) -> DataFrame:
    rows = attribute_hashes(attrs, ignore).join(neighbours.select(*VERSION, "prev_sesno", "next_sesno"), VERSION)
    own = Window.partitionBy(*ELEMENT, "kind", "key").orderBy("sesno")
    seen = rows.withColumn("at_before", F.lag("sesno").over(own)).withColumn("h_before", F.lag("h").over(own)).withColumn("at_after", F.lead("sesno").over(own))
    came = F.col("prev_sesno").isNotNull() & ~F.col("at_before").eqNullSafe(F.col("prev_sesno"))
    altered = F.col("prev_sesno").isNotNull() & F.col("at_before").eqNullSafe(F.col("prev_sesno")) & (F.col("h") != F.col("h_before"))
    went = F.col("next_sesno").isNotNull() & ~F.col("at_after").eqNullSafe(F.col("next_sesno"))
    change = F.array_compact(F.array(
        F.when(came, F.struct("sesno", F.lit("added").alias("change"))),
        F.when(altered, F.struct("sesno", F.lit("modified").alias("change"))),
        F.when(went, F.struct(F.col("next_sesno").alias("sesno"), F.lit("deleted").alias("change"))),
    ))
    return seen.select(*ELEMENT, "kind", "key", F.explode(change).alias("c")).select(*ELEMENT, "c.sesno", "kind", "key", "c.change")


def change_counts(versions: DataFrame, attrs: DataFrame, last_n: int | None = None) -> DataFrame:
    """(change_key, n): how often each attribute, name, owner or child list changed between neighbouring versions; last_n limits to the newest versions."""
    pairs = _pairs(versions).where("not deleted and prev is not null and not prev.deleted")
    deltas = attribute_deltas(versions, attrs)
    if last_n is not None:
        newest = Window.partitionBy(*ELEMENT).orderBy(F.desc("sesno"))
        recent = standing(versions).where("not deleted").select(*VERSION, F.row_number().over(newest).alias("n")).where(F.col("n") < last_n).drop("n")
        pairs, deltas = pairs.join(recent, VERSION, "left_semi"), deltas.join(recent, VERSION, "left_semi")

    def differs(c: str) -> Column:
        return ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))

    changed_owner = ~(F.col("owner_ref0").eqNullSafe(F.col("prev.owner_ref0")) & F.col("owner_ref1").eqNullSafe(F.col("prev.owner_ref1")))
    meta = F.array_compact(F.array(
        F.when(differs("name"), F.lit("meta:name")), F.when(differs("noun"), F.lit("meta:noun")), F.when(changed_owner, F.lit("meta:owner")),
        F.when(~F.coalesce("children", F.array()).eqNullSafe(F.coalesce("prev.children", F.array())), F.lit("meta:children")),
    ))
    keys = pairs.select(F.explode(meta).alias("change_key")).unionByName(deltas.select(F.concat_ws(":", "kind", F.regexp_replace("key", "^:", "")).alias("change_key")))
    return keys.groupBy("change_key").agg(F.count(F.lit(1)).alias("n"))


def top_changes(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "change_key").limit(n)


def _owner_as_of(pairs: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners and their lists at the session of the version that names them: (dbnum, owner, sesno) with owner_sesno, and the children of (dbnum, owner, owner_sesno).

    Asked sessions are distinct, so a window holds at most twice the sessions of a database, however many elements name one owner.
    """
    owner = ["dbnum", "owner_ref0", "owner_ref1"]
    states = standing(versions).select("dbnum", F.col("ref0").alias("owner_ref0"), F.col("ref1").alias("owner_ref1"), "sesno", "deleted", "children")
    asked = pairs.select(*owner, "sesno").where("owner_ref0 is not null and owner_ref1 is not null").distinct()
    known = states.select(*owner, "sesno", F.struct("sesno", "deleted").alias("state"), F.lit(0).alias("side"))
    both = known.unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*owner).orderBy("sesno", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("state", F.last("state", ignorenulls=True).over(upto)).where("side = 1 and not state.deleted").select(*owner, "sesno", F.col("state.sesno").alias("owner_sesno"))
    lists = states.where("not deleted").select(*owner, F.col("sesno").alias("owner_sesno"), F.explode("children").alias("c"))
    return found, lists.select(*owner, "owner_sesno", F.col("c.ref0").alias("ref0"), F.col("c.ref1").alias("ref1")).distinct()


def operation_status(versions: DataFrame, attrs: DataFrame, owner_as_of: str = "latest") -> DataFrame:
    """What each session did to each element: (VERSION, operation, children_changed, n_attributes).

    In order: a removal is Deleted; no version before is Add; an owner that is
    given but does not exist, or exists but does not list the element, is Deleted (a SITE may lack
    its owner); a difference in the set of children, noun, name, owner or any attribute is Modified; without
    difference there is no row. A version that passes the owner's test also makes every child that it
    lists no more Deleted in its session, unless the child has a row of its own there.
    owner_as_of: the owner is read as it is now (``latest``) or as it was in the version's session (``session``).
    """
    return _status(_pairs(versions), versions, attribute_deltas(versions, attrs, BOOKKEEPING), owner_as_of)


def _status(pairs: DataFrame, versions: DataFrame, deltas: DataFrame, owner_as_of: str) -> DataFrame:
    """The rules over pairs of neighbouring versions; versions are those that owners are looked up in."""
    if owner_as_of not in ("latest", "session"):
        raise ValueError(f"owners are read as of latest or session, not {owner_as_of}")
    owner = ["dbnum", "owner_ref0", "owner_ref1"]
    deltas = deltas.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("n_attributes"))
    if owner_as_of == "latest":
        now = existing(versions).select("dbnum", F.col("ref0").alias("owner_ref0"), F.col("ref1").alias("owner_ref1"), "children")
        owners = now.select(*owner, F.lit(True).alias("has_owner"))
        listed = now.select(*owner, F.explode("children").alias("c")).select(*owner, F.col("c.ref0").alias("ref0"), F.col("c.ref1").alias("ref1")).distinct().withColumn("in_list", F.lit(True))
        rows = pairs.join(owners, owner, "left").join(listed, [*ELEMENT, "owner_ref0", "owner_ref1"], "left")
    else:
        found, lists = _owner_as_of(pairs, versions)
        rows = pairs.join(found.withColumn("has_owner", F.lit(True)), [*owner, "sesno"], "left").join(lists.withColumn("in_list", F.lit(True)), [*ELEMENT, "owner_ref0", "owner_ref1", "owner_sesno"], "left")
    rows = rows.join(deltas, VERSION, "left")

    none = F.coalesce((F.col("owner_ref0") == 0) & (F.col("owner_ref1") == 0), F.lit(True)) | F.col("owner_ref0").isNull()
    gone = ~none & F.when(F.col("has_owner").isNull(), F.coalesce(F.col("noun") != "SITE", F.lit(True))).otherwise(F.col("in_list").isNull())
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array())))
    children_changed = ~as_set("children").eqNullSafe(as_set("prev.children"))
    other = F.lit(False)
    for c in ("noun", "name", "owner_ref0", "owner_ref1"):
        other = other | ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    first = F.col("prev").isNull() | F.col("prev.deleted")
    operation = F.when(F.col("deleted"), "Deleted").when(first, "Add").when(gone, "Deleted").when(children_changed | other | F.col("n_attributes").isNotNull(), "Modified")
    gone_children = F.when(~F.col("deleted") & ~first & ~gone, F.array_except(F.coalesce("prev.children", F.array()), F.coalesce("children", F.array())))
    judged = rows.select(*VERSION, operation.alias("operation"), F.coalesce(operation == "Modified", F.lit(False)).alias("m"), children_changed.alias("c"), F.coalesce("n_attributes", F.lit(0)).alias("n"), gone_children.alias("dropped"))
    # What a version says of itself and of children, in one pass: narrow rows, of which one stays per element and session. An element's own row comes before what a parent says.
    said = F.expr(
        "concat(if(operation is null, array(), array(struct(ref0, ref1, 0 as from_parent, operation, m and c as children_changed, if(m, n, 0L) as n_attributes))),"
        " transform(filter(coalesce(dropped, array()), x -> x.ref0 is not null and x.ref1 is not null), x -> struct(x.ref0 as ref0, x.ref1 as ref1, 1 as from_parent, 'Deleted' as operation, false as children_changed, 0L as n_attributes)))"
    )
    told = judged.select("dbnum", "sesno", F.explode(said).alias("x")).select("dbnum", "sesno", "x.*")
    best = told.groupBy(*VERSION).agg(F.min(F.struct("from_parent", "operation", "children_changed", "n_attributes")).alias("x"))
    return best.select(*VERSION, "x.operation", "x.children_changed", "x.n_attributes")


def dropped_children(versions: DataFrame) -> DataFrame:
    """(dbnum, sesno, ref0, ref1, child_ref0, child_ref1): children a version lists no more."""
    gone = F.array_except(F.coalesce("prev.children", F.array()), F.coalesce("children", F.array()))
    rows = _pairs(versions).where("not deleted and prev is not null and not prev.deleted")
    return rows.select("dbnum", "sesno", "ref0", "ref1", F.explode(gone).alias("c")).select("dbnum", "sesno", "ref0", "ref1", F.col("c.ref0").alias("child_ref0"), F.col("c.ref1").alias("child_ref1"))


def version_status(versions: DataFrame) -> DataFrame:
    """(ELEMENT, operation) of the newest version by the number of versions alone: Deleted if removed, Add if there is one version, else Modified."""
    counts = standing(versions).groupBy(*ELEMENT).agg(F.count(F.lit(1)).alias("n"), F.max_by("deleted", "sesno").alias("deleted"))
    return counts.select(*ELEMENT, F.when(F.col("deleted"), "Deleted").when(F.col("n") == 1, "Add").otherwise("Modified").alias("operation"))


def primary_status(versions: DataFrame) -> DataFrame:
    """(ELEMENT, operation) of the newest version, judged by the owners' present child lists.

    In order: a removal is Deleted; no earlier version that is not a removal is Add;
    an owner that does not list the element is Deleted; so is an element whose
    previous owner lists a child that the present owner does not; else Modified.
    An element without an owner is in no list and is not judged by one; a given
    owner that does not exist lists nothing (a SITE may lack its owner); a
    previous owner that does not exist vouches for no child.
    """
    rows = standing(versions)
    previous = F.max(F.when(~F.col("deleted"), F.struct("sesno", "owner_ref0", "owner_ref1"))).over(Window.partitionBy(*ELEMENT).orderBy("sesno").rowsBetween(Window.unboundedPreceding, -1))
    newest = Window.partitionBy(*ELEMENT).orderBy(F.desc("sesno"))
    last = rows.withColumn("prev", previous).withColumn("k", F.row_number().over(newest)).where("k = 1").select(*ELEMENT, "deleted", "noun", "owner_ref0", "owner_ref1", "prev")
    last = last.withColumn("prev0", F.col("prev.owner_ref0")).withColumn("prev1", F.col("prev.owner_ref1"))

    now = existing(versions).select("dbnum", F.col("ref0").alias("owner_ref0"), F.col("ref1").alias("owner_ref1"), F.coalesce("children", F.array()).alias("list"))
    owners = now.select("dbnum", "owner_ref0", "owner_ref1", F.lit(True).alias("has_owner"))
    listed = now.select("dbnum", "owner_ref0", "owner_ref1", F.explode("list").alias("c")).select("dbnum", "owner_ref0", "owner_ref1", F.col("c.ref0").alias("ref0"), F.col("c.ref1").alias("ref1")).distinct().withColumn("in_list", F.lit(True))

    # Lists meet once per pair of owners, not once per element.
    moves = last.where("not deleted and prev is not null and not (owner_ref0 <=> prev0 and owner_ref1 <=> prev1)").select("dbnum", "owner_ref0", "owner_ref1", "prev0", "prev1").distinct()
    before = now.select("dbnum", F.col("owner_ref0").alias("prev0"), F.col("owner_ref1").alias("prev1"), F.col("list").alias("prev_list"))
    both = moves.join(before, ["dbnum", "prev0", "prev1"]).join(now, ["dbnum", "owner_ref0", "owner_ref1"])
    lost = both.where(F.size(F.array_except("prev_list", "list")) > 0).select("dbnum", "owner_ref0", "owner_ref1", "prev0", "prev1", F.lit(True).alias("lost"))

    out = last.join(owners, ["dbnum", "owner_ref0", "owner_ref1"], "left").join(listed, [*ELEMENT, "owner_ref0", "owner_ref1"], "left").join(lost, ["dbnum", "owner_ref0", "owner_ref1", "prev0", "prev1"], "left")
    none = F.col("owner_ref0").isNull() | F.col("owner_ref1").isNull() | ((F.col("owner_ref0") == 0) & (F.col("owner_ref1") == 0))
    dropped = ~none & F.when(F.col("has_owner").isNull(), F.coalesce(F.col("noun") != "SITE", F.lit(True))).otherwise(F.col("in_list").isNull())
    return out.select(*ELEMENT, F.when(F.col("deleted"), "Deleted").when(F.col("prev").isNull(), "Add").when(dropped | F.col("lost").isNotNull(), "Deleted").otherwise("Modified").alias("operation"))


def increments(versions: DataFrame, attrs: DataFrame, sessions: DataFrame | None = None, first: int | None = None, last: int | None = None, owner_as_of: str = "latest", only_latest: bool = False) -> DataFrame:
    """operation_status() of some sessions: a range, a table of (dbnum, sesno), or both.

    Only elements that those sessions wrote are looked at: their versions of those sessions are compared with the version before each, and
    only the attributes of these are hashed. Of the others the owners they name are read. only_latest keeps what versions say that are their element's newest.
    """
    upto = versions if last is None else versions.where(F.col("sesno") <= last)
    asked = F.lit(True) if first is None else F.col("sesno") >= first
    written_in = upto.where(asked)
    if sessions is not None:
        chosen = sessions.select("dbnum", "sesno").distinct()
        written_in = written_in.join(chosen, ["dbnum", "sesno"], "left_semi")
    rows = standing(upto.join(written_in.select(*ELEMENT).distinct(), ELEMENT, "left_semi"))
    if sessions is not None:
        rows = rows.join(chosen.withColumn("_chosen", F.lit(True)), ["dbnum", "sesno"], "left")
        asked = asked & F.col("_chosen").isNotNull()
    rows = rows.withColumn("_asked", asked)
    order = Window.partitionBy(*ELEMENT).orderBy("sesno")
    fields = ["sesno", "noun", "owner_ref0", "owner_ref1", "name", "children", "deleted"]
    near = rows.withColumn("prev", F.lag(F.struct(*fields)).over(order))
    pairs = near.where("_asked").select(*VERSION, "byte_offset", *fields[1:], "prev")
    if only_latest:
        newest = versions.groupBy(*ELEMENT).agg(F.max("sesno").alias("sesno"))
        pairs = pairs.join(newest, VERSION, "left_semi")
    order_asked = F.coalesce(F.lead("_asked").over(order), F.lit(False))
    wanted = _neighbours(rows).withColumn("_next", order_asked).where("_asked or _next")
    deltas = _deltas(wanted, attrs.join(wanted.select(*VERSION), VERSION, "left_semi"), BOOKKEEPING)
    named = pairs.select("dbnum", F.col("owner_ref0").alias("ref0"), F.col("owner_ref1").alias("ref1")).distinct()
    return _status(pairs, versions.join(named, ELEMENT, "left_semi"), deltas, owner_as_of)


def recent_sessions(sessions: DataFrame, n: int = 1) -> DataFrame:
    """(dbnum, sesno) of the n newest sessions of every database."""
    newest = Window.partitionBy("dbnum").orderBy(F.desc("sesno"))
    return sessions.select("dbnum", "sesno").where("sesno is not null").distinct().withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n).drop("k")


def latest_state(versions: DataFrame, attrs: DataFrame) -> DataFrame:
    """(ELEMENT, sesno, operation): the last decisive operation on every element; deleted ones are left out.

    A version that changed nothing is not decisive, so an older session may supply the operation.
    """
    last = operation_status(versions, attrs).groupBy(*ELEMENT).agg(F.max(F.struct("sesno", "operation")).alias("x"))
    return last.select(*ELEMENT, "x.*").where("operation != 'Deleted'")


def newest_and_older(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest version of every element, and all others as history."""
    newest = Window.partitionBy(*ELEMENT).orderBy(F.desc("sesno"))
    ranked = standing(versions).withColumn("k", F.row_number().over(newest))
    return ranked.where("k = 1").drop("k"), ranked.where("k > 1").drop("k")
