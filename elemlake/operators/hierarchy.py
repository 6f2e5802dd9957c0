"""Parent-child links to full hierarchies, by heavy-path decomposition.

1. Pointer doubling finds, for each node, its ancestor 2^k steps up and the
   number of descendants less than 2^k steps down. Nodes whose chain of
   ancestors ends are in trees; when a round ends no further node, the rest
   are on or below loops (depths have no gaps). This takes log2(depth)
   rounds and gives all subtree sizes.
2. The child with the largest subtree is its parent's heavy child. Heavy
   links form chains; doubling along them labels each node with its chain's
   head and its place in the chain.
3. A root path crosses at most log2(nodes) chains. From the roots down, a
   level of chains at a time, every chain gets its root, the depth and preorder number of
   its head and the path to it, from its parent chain. Nodes read theirs
   off their chain: depth is the head's plus the place, the path is the chain's
   plus a piece of the chain, and the descendants of a node are the preorder
   interval of its subtree. Where paths are asked for, chains are cut into
   segments, which follow one another as chains do, so that no row lists more than a segment.

Defined results: null refnos and refnos outside 32 bits a word name no
element; of the versions of one element the one with the largest (sesno,
byte_offset) counts; several possible holders of an ownerless element count
as none; a self-reference is a loop; repeated rows change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.skew import sums_before
from elemlake.plans.workspace import release, written, written_counting

#: The least number of blocks over which the children of one parent are spread when their subtrees are laid out, and the chains for which there is one more.
SIBLING_BLOCKS, CHAINS_PER_BLOCK = 64, 200_000
#: Nodes of a chain that one row may list; longer chains are cut into segments where paths are asked for.
SEGMENT = 4096


def node_id(ref0: str, ref1: str) -> Column:
    """A refno as one integer; null if a word is missing or no 32-bit number."""
    fits = " and ".join(f"{c} between 0 and 4294967295" for c in (ref0, ref1))
    return F.expr(f"case when {fits} then shiftleft({ref0}, 32) | {ref1} end")


def words(node: str) -> tuple[Column, Column]:
    return F.shiftrightunsigned(node, 32), F.col(node).bitwiseAND(F.lit(0xFFFFFFFF))


def last_versions(versions: DataFrame) -> DataFrame:
    """(id, owner, noun, name, children) of the elements that exist now; owner null if none is given."""
    owner = F.when((F.col("owner_ref0") != 0) | (F.col("owner_ref1") != 0), node_id("owner_ref0", "owner_ref1"))
    row = F.struct("sesno", "byte_offset", F.coalesce("deleted", F.lit(False)).alias("deleted"), owner.alias("owner"), "noun", "name", "children")
    last = versions.select(node_id("ref0", "ref1").alias("id"), row.alias("v")).where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    return last.where("not v.deleted").select("id", "v.owner", "v.noun", "v.name", "v.children")


def parent_links(versions: DataFrame) -> DataFrame:
    """(id, parent): each existing element with its existing parent, or null."""
    last = written(last_versions(versions).select("id", "owner", "children"), "last-versions")  # read for owners, for existence and for children
    slim = last.select("id", "owner")
    owned = slim.where("owner is not null").join(slim.select(F.col("id").alias("owner"), F.col("id").alias("parent")), "owner", "left").select("id", "parent")
    held = last.select(F.col("id").alias("holder"), F.explode("children").alias("c")).select(node_id("c.ref0", "c.ref1").alias("id"), "holder").where("id is not null")
    loose = slim.where("owner is null").select("id")
    holders = held.join(loose, "id").groupBy("id").agg(F.min("holder").alias("low"), F.max("holder").alias("high"))
    unowned = loose.join(holders, "id", "left").select("id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("parent"))
    return owned.unionByName(unowned)


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cycle separation: (id, parent, size) of the nodes in trees, and (id) of those on or below loops."""
    up = F.col("up").isNotNull()
    nodes, climbing = written_counting(links.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), "doubling", up)
    while climbing:
        add = nodes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        jumps = nodes.where("up is not null").select("id", "up").join(nodes.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").where("next is not null").select("id", "next")
        step = nodes.select("id", "parent", "size").join(add, "id", "left").join(jumps, "id", "left")
        after, left = written_counting(step.select("id", "parent", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "doubling", up)
        release(nodes)
        nodes = after
        if left == climbing:
            break
        climbing = left
    return nodes.where("up is null").select("id", "parent", "size"), nodes.where("up is not null").select("id")


def chain_labels(trees: DataFrame) -> tuple[DataFrame, int]:
    """(id, parent, size, heavy, head, place): each tree node with its chain's head and its place in the chain; heavy is its heavy child. Also how many chains there are."""
    heavy = trees.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.max(F.struct("size", (-F.col("id")).alias("id"))).alias("h")).select("id", (-F.col("h.id")).alias("heavy"), F.col("h.size").alias("heavy_size"))
    with_heavy = written(trees.join(heavy, "id", "left"), "heavy")
    is_heavy = with_heavy.where("heavy is not null").select(F.col("heavy").alias("id"), F.col("id").alias("above"))
    start = with_heavy.select("id").join(is_heavy, "id", "left").select("id", F.coalesce("above", "id").alias("head"), F.when(F.col("above").isNull(), 0).otherwise(1).cast("bigint").alias("place"))
    labels, open_count = written_counting(start.withColumn("done", F.col("place") == 0), "chains", ~F.col("done"))
    while open_count:
        open_ = labels.where("not done").select("id", F.col("head").alias("via"), "place")
        there = labels.select(F.col("id").alias("via"), F.col("head").alias("far"), F.col("place").alias("more"), F.col("done").alias("far_done"))
        moved = open_.join(there, "via").select("id", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("far_done").alias("done"))
        after, open_count = written_counting(labels.where("done").unionByName(moved), "chains", ~F.col("done"))
        release(labels)
        labels = after
    out, n_chains = written_counting(with_heavy.join(labels.drop("done"), "id"), "labels", F.col("place") == 0)
    release(labels)
    release(with_heavy)
    return out, n_chains


def cut_chains(labels: DataFrame, segment: int) -> DataFrame:
    """labels with ``cut``: chains longer than a segment as several, each hanging on the one before by its heavy link."""
    whole = labels.withColumn("cut", F.lit(False))
    if labels.where(F.col("place") >= segment).isEmpty():
        return whole
    number = F.floor(F.col("place") / segment).cast("bigint")
    starts = labels.where(F.col("place") % segment == 0).select("head", number.alias("number"), F.col("id").alias("start"))
    parts = labels.withColumn("number", number).join(starts, ["head", "number"])
    return written(parts.select("id", "parent", "size", "heavy", "heavy_size", F.col("start").alias("head"), (F.col("place") % segment).alias("place"), (F.col("number") > 0).alias("cut")), "segments")


def chain_table(labels: DataFrame, n_chains: int, paths: bool = False) -> DataFrame:
    """(head, root, depth, preorder[, prefix]) of every chain; prefix is the path to the head's parent."""
    heads = labels.where("place = 0").select(F.col("id").alias("head"), "parent", "size", "cut")
    blocks = SIBLING_BLOCKS + n_chains // CHAINS_PER_BLOCK
    # Where a chain's subtree starts below its parent: after the heavy subtree and the light siblings before it. A further segment is the heavy subtree itself.
    light = heads.where("parent is not null and not cut").withColumn("block", F.pmod(F.xxhash64("head"), F.lit(blocks)))
    laid = sums_before(light, ["parent"], "block", ["head"], "size", "before").select("head", "parent", "before", "cut")
    laid = laid.unionByName(heads.where("cut").select("head", "parent", F.lit(0).cast("bigint").alias("before"), "cut"))
    above = labels.select(F.col("id").alias("parent"), F.col("head").alias("parent_chain"), F.col("place").alias("parent_place"), "heavy_size")
    after_heavy = F.when(F.col("cut"), F.lit(0)).otherwise(F.coalesce("heavy_size", F.lit(0)))
    waiting = laid.join(above, "parent").select("head", "parent_chain", "parent_place", (F.col("parent_place") + 1 + after_heavy + F.col("before")).alias("offset"))
    done_columns = [F.col("head"), F.col("head").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("preorder")]
    if paths:
        # The nodes of a chain, no more than a segment's.
        members = written(labels.groupBy(F.col("head").alias("parent_chain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("members")), "members")
        done_columns.append(F.array().cast("array<bigint>").alias("prefix"))
    level = written(heads.where("parent is null").select(*done_columns), "chain-level")
    waiting = written(waiting, "chains-waiting")
    levels = [level]
    while True:
        up = level.withColumnRenamed("head", "parent_chain").withColumnRenamed("depth", "up_depth").withColumnRenamed("preorder", "up_preorder")
        columns = [F.col("head"), F.col("root"), (F.col("up_depth") + F.col("parent_place") + 1).alias("depth"), (F.col("up_preorder") + F.col("offset")).alias("preorder")]
        found = waiting.join(up, "parent_chain")
        if paths:
            found = found.join(members, "parent_chain")
            columns.append(F.concat(F.col("prefix"), F.slice("members", F.lit(1), (F.col("parent_place") + 1).cast("int"))).alias("prefix"))
        level, n = written_counting(found.select(*columns), "chain-level", F.lit(True))
        if n == 0:
            release(level)
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    if paths:
        out = out.join(members.withColumnRenamed("parent_chain", "head"), "head")
    return out


def hierarchy(links: DataFrame, paths: bool = False, segment: int = SEGMENT) -> DataFrame:
    """A row per node of links (id, parent): (id, root, depth, preorder, last_descendant, n_descendants[, path]).

    The descendants of x are the nodes of its root whose preorder lies in
    (x.preorder, x.last_descendant]. Nodes on or below a loop have depth -1
    and nulls otherwise.
    """
    trees, loops = subtree_sizes(links)
    labels, n_chains = chain_labels(trees)
    labels = cut_chains(labels, segment) if paths else labels.withColumn("cut", F.lit(False))
    chains = chain_table(labels, n_chains, paths)
    joined = labels.select("id", "head", "place", "size").join(chains, "head")
    first = F.col("preorder") + F.col("place")
    columns = ["id", "root", (F.col("depth") + F.col("place")).cast("int").alias("depth"), first.alias("preorder"), (first + F.col("size") - 1).alias("last_descendant"), (F.col("size") - 1).alias("n_descendants")]
    if paths:
        columns.append(F.concat("prefix", F.slice("members", F.lit(1), (F.col("place") + 1).cast("int"))).alias("path"))
    return joined.select(*columns).unionByName(loops.select("id", F.lit(-1).alias("depth")), allowMissingColumns=True)


def subtree_sums(tree: DataFrame, amount: str, bits: int = 14) -> DataFrame:
    """(id, total): the sum of an amount over every node and its descendants, read off the preorder intervals of hierarchy() rows that have it.

    What comes before a node in its tree is summed in blocks of 2^bits places, so a tree may hold all nodes; nodes on or below loops have no total.
    """
    rows = tree.where("preorder is not null").select("id", "root", "preorder", "last_descendant", F.col(amount).alias("amount"), F.shiftright("preorder", bits).alias("block"))
    summed = written(sums_before(rows, ["root"], "block", ["preorder"], "amount", "before"), "subtree-sums")
    last = summed.select("root", F.col("preorder").alias("last_descendant"), (F.col("before") + F.col("amount")).alias("through"))
    return summed.join(last, ["root", "last_descendant"]).select("id", (F.col("through") - F.col("before")).alias("total"))


def element_hierarchy(versions: DataFrame, paths: bool = False) -> DataFrame:
    """The hierarchy of the elements that exist now, with refnos; elements on or below a loop have root (0, 0) and depth -1."""
    tree = hierarchy(parent_links(versions), paths)
    zero = F.lit(0).cast("bigint")
    root = [F.coalesce(w, zero) for w in words("root")]
    columns = [*[w.alias(n) for w, n in zip(words("id"), ("ref0", "ref1"))], root[0].alias("root_ref0"), root[1].alias("root_ref1"), "depth", "preorder", "last_descendant", "n_descendants"]
    if paths:
        columns.append(F.expr("array_join(transform(path, x -> concat(shiftrightunsigned(x, 32), '/', x & 4294967295)), ' > ')").alias("path"))
    return tree.select(*columns)
