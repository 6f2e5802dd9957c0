"""Walking down the element tree.

Without a depth limit by links of doubling length; with one, a level at a
time: one equi join of the frontier with the edges and an anti join with
what was seen, so loops end and repeated nodes count once. Rounds are written
to the shared folder, so that no plan holds those before it.
For all nodes at once use operators.hierarchy, whose rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elemlake.operators.lookup import ELEMENT, existing, known_children
from elemlake.plans.workspace import release, written, written_counting


def child_edges(versions: DataFrame) -> DataFrame:
    """(dbnum, parent0, parent1, ref0, ref1): child links between existing elements."""
    return known_children(versions).select("dbnum", F.col("ref0").alias("parent0"), F.col("ref1").alias("parent1"), F.col("child_ref0").alias("ref0"), F.col("child_ref1").alias("ref1")).distinct()


def descend(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(dbnum, ref0, ref1, depth) of everything below the roots, each node at its least depth. max_depth None is unlimited, 0 the roots only."""
    edges = written(edges, "edges")
    roots = roots.select(*ELEMENT).distinct().withColumn("depth", F.lit(0))
    if max_depth is None:
        found = _by_doubling(roots, edges)
        if found is not None:
            return found
    return _by_level(roots, edges, max_depth)


def _parents(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("dbnum", F.col("ref0").alias("parent0"), F.col("ref1").alias("parent1"), *more)


def _by_doubling(roots: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Links over 1, 2, 4, ... levels reach everything in log2(depth) rounds; None if many nodes have several parents, whose links multiply.

    Depths have no gaps, so a round that reaches nothing new is the last.
    """
    hops, most, step = edges, 2 * edges.count(), 1
    reached, size = written_counting(roots, "reached", F.lit(True))
    while True:
        far = _parents(reached, "depth").join(hops, ["dbnum", "parent0", "parent1"]).select(*ELEMENT, (F.col("depth") + step).alias("depth"))
        after, count = written_counting(reached.unionByName(far).groupBy(*ELEMENT).agg(F.min("depth").alias("depth")), "reached", F.lit(True))
        release(reached)
        reached = after
        if count == size:
            return reached
        size, step = count, step * 2
        middle = hops.select("dbnum", "parent0", "parent1", F.col("ref0").alias("middle0"), F.col("ref1").alias("middle1"))
        below = hops.select("dbnum", F.col("parent0").alias("middle0"), F.col("parent1").alias("middle1"), "ref0", "ref1")
        longer, count = written_counting(middle.join(below, ["dbnum", "middle0", "middle1"]).drop("middle0", "middle1").distinct(), "hops", F.lit(True))
        if count > most:
            return None
        hops = longer


def _by_level(roots: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    frontier = written(roots, "level")
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        below = _parents(frontier).join(edges, ["dbnum", "parent0", "parent1"])
        frontier = written(below.select(*ELEMENT).distinct().join(seen, ELEMENT, "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            release(frontier)
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # keeps the union of seen levels short in deep trees
            seen = written(seen, "seen")
    return seen


def below_worlds(versions: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What is reachable from the world elements."""
    worlds = existing(versions).where("noun = 'WORL'")
    return descend(worlds, child_edges(versions), max_depth)


def siblings(versions: DataFrame) -> DataFrame:
    """(ELEMENT of the child, prev_ref1, next_ref1, is_first, is_last) in the parent's list.

    Neighbours are read off the list itself, before it is taken apart: a row a child holds what is beside it, not the list.
    """
    beside = "transform(children, (c, i) -> struct(c.ref0 as ref0, c.ref1 as ref1, i as ord, get(children, i - 1).ref1 as prev_ref1, get(children, i + 1).ref1 as next_ref1, i = 0 as is_first, i = size(children) - 1 as is_last))"
    now = existing(versions).select("dbnum", F.col("ref0").alias("parent0"), F.col("ref1").alias("parent1"), F.expr(beside).alias("beside"))
    return now.select("dbnum", "parent0", "parent1", F.explode("beside").alias("c")).select("dbnum", "parent0", "parent1", "c.*")


def child_counts(versions: DataFrame) -> DataFrame:
    """(ELEMENT, n_listed, n_distinct) of existing elements."""
    return existing(versions).select(*ELEMENT, F.coalesce(F.size("children"), F.lit(0)).alias("n_listed"), F.coalesce(F.size(F.array_distinct("children")), F.lit(0)).alias("n_distinct"))
