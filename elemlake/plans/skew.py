"""Ordered computations inside groups of any size.

A plain window over a group that holds a third of all rows runs in one task.
These helpers cut every group into blocks, work inside the blocks, and carry
one small row per (group, block) across. Their results equal the plain
window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.workspace import written


def cut_points(df: DataFrame, order: Column, blocks: int) -> list:
    """Values of a numeric column that cut all rows into about equal blocks; one pass, blocks - 1 numbers to the driver."""
    if blocks <= 1:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    found = df.select(F.percentile_approx(order, F.array(*[F.lit(x) for x in shares]), F.lit(blocks * 20)).alias("q")).first()
    return sorted(set(found["q"] or [])) if found else []


def block_of(order: Column, cuts: list) -> Column:
    """The number of cut points below the value, as a balanced tree of comparisons; constant cuts, so every use agrees."""
    if not cuts:
        return F.lit(0)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        m = (low + high) // 2
        return F.when(order <= F.lit(cuts[m]), tree(low, m)).otherwise(tree(m + 1, high))

    return tree(0, len(cuts))


def long_groups(df: DataFrame, keys: list[str], order: str, rows_per_block: int) -> DataFrame | None:
    """How to cut groups of more than rows_per_block rows by a bigint order: (keys, _major, _before, _n, _low, _high), or None if there is no such group.

    _major is the order's high word, _before the number of the group's rows with a lower one, and _low and _high bound the low words. The table has a row per
    high word of a long group, and there are fewer such groups than rows / rows_per_block; it stays distributed.
    """
    long = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_block).drop("_rows"), "long-groups")
    if long.isEmpty():
        return None
    minor = F.col(order).bitwiseAND(F.lit(0xFFFFFFFF))
    counts = df.join(long, keys, "left_semi").groupBy(*keys, F.shiftright(order, 32).alias("_major")).agg(F.count(F.lit(1)).alias("_n"), F.min(minor).alias("_low"), F.max(minor).alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_major").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def cut_groups(df: DataFrame, keys: list[str], order: str, groups: DataFrame | None, rows_per_block: int) -> DataFrame:
    """df with ``block``, which rises with the order inside a group and holds about rows_per_block rows, and ``is_long``; 0 and false for groups that are not cut."""
    if groups is None:
        return df.withColumn("block", F.lit(0).cast("bigint")).withColumn("is_long", F.lit(False))
    joined = df.withColumn("_major", F.shiftright(order, 32)).join(groups, [*keys, "_major"], "left")
    inside = (F.col(order).bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1)
    block = F.floor((F.col("_before") + F.col("_n") * F.greatest(F.least(inside, F.lit(1.0)), F.lit(0.0))) / rows_per_block)
    return joined.withColumn("block", F.coalesce(block, F.lit(0)).cast("bigint")).withColumn("is_long", F.col("_n").isNotNull()).drop("_major", "_before", "_n", "_low", "_high")


def carry_forward(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str, inclusive: bool, split: Column | bool = True) -> DataFrame:
    """Adds the last non-null value at (inclusive) or before each row of its group, in the given order.

    block is an integer column that rises with order. Work inside (keys,
    block) is a window; across blocks goes one row each. split says which
    rows are of groups in several blocks, so that others stay out of that;
    False means that there are none.
    """
    last = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = df.withColumn("_value", value).withColumn("_inside", F.last("_value", ignorenulls=True).over(last))
    if split is False:
        return inside.withColumn(out, F.col("_inside")).drop("_value", "_inside")
    rank = F.struct(*order)
    several = df if split is True else df.where(split)
    tails = several.withColumn("_value", value).groupBy(*keys, block).agg(F.max_by(F.when(F.col("_value").isNotNull(), F.col("_value")), F.when(F.col("_value").isNotNull(), rank)).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(earlier)).where(F.col("_carried").isNotNull()).drop("_tail")
    return inside.join(carried, [*keys, block], "left").withColumn(out, F.coalesce("_inside", "_carried")).drop("_value", "_inside", "_carried")


def row_numbers(df: DataFrame, keys: list[str], block: str, order: list[Column | str], out: str) -> DataFrame:
    """Adds row_number() - 1 within keys, ordered by (block, order)."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)) - 1
    return df.withColumn("_at", inside).join(starts, [*keys, block]).withColumn(out, (F.col("_start") + F.col("_at")).cast("bigint")).drop("_start", "_at")


def sums_before(df: DataFrame, keys: list[str], block: str, order: list[Column | str], amount: str, out: str) -> DataFrame:
    """Adds the sum of amount over the earlier rows within keys, ordered by (block, order)."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, block).agg(F.sum(amount).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_at", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(starts, [*keys, block]).withColumn(out, F.col("_start") + F.col("_at")).drop("_start", "_at")
