"""Filling fixed-capacity containers with documents: hierarchical multi-length packing.

Documents longer than the capacity are cut into full containers and one
rest; nothing else is split.

1. Tiers: tier t has windows of capacity / 2^t. A piece is routed to the tier of the
   smallest window that holds it (the last tier takes all shorter ones).
2. Every tier is packed on its own, from the longest: each of its pieces
   opens a window, whose gap is filled from the shorter tiers, the longest
   piece that fits first. The last tier has only its own pieces to fill with.
3. Windows become containers: a long window opens one, and its gap is filled
   with whole windows of shorter tiers, the fullest that fits first.
4. Containers are numbered by falling cost (sum of squared lengths, which is
   what attention costs) and dealt to step groups in serpentine order, so the
   groups of one step take about equally long.

All of that happens on the histogram of lengths, which has no more bars than
the capacity, or than MOST_BARS, however many documents there are: a window is repeated for as
many pieces as allow it at once. Every target's histogram is packed in a task of its own.
The outcome is a plan of segments: pieces number a to b of one length lie in
containers c and after. Pieces are numbered within their length (block-wise,
so a length that a third of all documents have is spread) and meet the plan
in a join on cells of piece numbers.

Defined results: null and empty texts have no tokens, take no space and are
spread over the containers; repeated documents are packed as often as they
occur; targets without a positive capacity are left out; no documents give
no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elemlake.plans.skew import row_numbers
from elemlake.plans.workspace import written

#: Containers of one step group.
GROUP_SIZE = 64
#: The smallest window that has a tier of its own.
LEAST_WINDOW = 128
#: Bars of a histogram; lengths of larger capacities are planned in coarser units.
MOST_BARS = 1 << 20
#: Targets of one plan.
MOST_TARGETS = 500
#: Piece numbers of one cell of the join with the plan, as a power of two.
CELL_BITS = 10

SEGMENTS = "target int, length bigint, start bigint, pieces bigint, container bigint, each bigint, offset bigint, tier int, window bigint, containers bigint"


@dataclass
class Window:
    """A kind of window: its pieces (length, how many), how many such windows there are, and its tier."""

    items: list[tuple[int, int]]
    count: int
    tier: int

    @property
    def used(self) -> int:
        return sum(n * length for length, n in self.items)


@dataclass
class Container:
    """A kind of container: windows (kind, how many) and how many such containers there are."""

    windows: list[tuple[Window, int]]
    count: int

    @property
    def cost(self) -> int:
        return sum(times * n * length * length for w, times in self.windows for length, n in w.items)

    @property
    def used(self) -> int:
        return sum(times * w.used for w, times in self.windows)


def tiers_of(capacity: int, least: int = LEAST_WINDOW) -> list[int]:
    """The window sizes, longest first."""
    sizes = [capacity]
    while sizes[-1] // 2 >= least:
        sizes.append(sizes[-1] // 2)
    return sizes


def _fill(left: dict[int, int], lengths: list[int], size: int, longest: int) -> tuple[list[tuple[int, int]], int]:
    """One kind of window, opened by the longest piece and filled with the longest that fit, and how often it can be repeated."""
    chosen, gap, at = [], size, bisect_right(lengths, longest) - 1
    while at >= 0 and gap > 0:
        length = lengths[at]
        n = min(gap // length, left[length])
        if n:
            chosen.append((length, n))
            gap -= n * length
        at = min(bisect_right(lengths, gap), at) - 1
    return chosen, min(left[length] // n for length, n in chosen)


def _take(left: dict[int, int], lengths: list[int], chosen: list[tuple[int, int]], times: int) -> None:
    for length, n in chosen:
        left[length] -= n * times
        if not left[length]:
            del left[length]
            lengths.pop(bisect_right(lengths, length) - 1)


def windows(histogram: dict[int, int], capacity: int, least: int = LEAST_WINDOW) -> list[Window]:
    """Every tier packed. A round uses up a length or what is left of one, so there are about as many kinds as lengths."""
    left = {length: n for length, n in histogram.items() if n > 0 and 0 < length <= capacity}
    lengths = sorted(left)
    sizes = tiers_of(capacity, least)
    out = []
    for tier, size in enumerate(sizes):
        shorter = sizes[tier + 1] if tier + 1 < len(sizes) else 0
        while lengths and lengths[-1] > shorter:
            chosen, times = _fill(left, lengths, size, lengths[-1])
            out.append(Window(chosen, times, tier))
            _take(left, lengths, chosen, times)
    return out


def containers(kinds: list[Window], capacity: int) -> list[Container]:
    """Windows put together: by their fill, the fullest first, then window by window of that fill."""
    waiting: dict[int, deque[list]] = {}
    for w in sorted(kinds, key=lambda w: (w.tier, -w.used)):
        waiting.setdefault(w.used, deque()).append([w, w.count])
    left = {used: sum(n for _, n in q) for used, q in waiting.items()}
    fills = sorted(left)
    out = []
    while fills:
        chosen, times = _fill(left, fills, capacity, fills[-1])
        _take(left, fills, chosen, times)
        while times:
            # As many containers as have the same kinds of windows.
            run = min([times, *(waiting[used][0][1] // n for used, n in chosen)])
            made: list[tuple[Window, int]] = []
            for used, n in chosen:
                need, many = n, max(run, 1)
                while need:
                    head = waiting[used][0]
                    take = n if run else min(need, head[1])
                    made.append((head[0], take))
                    head[1] -= take * many
                    need -= take
                    if not head[1]:
                        waiting[used].popleft()
            out.append(Container(made, max(run, 1)))
            times -= max(run, 1)
    return out


def plan(histogram: dict[int, int], capacity: int, least: int = LEAST_WINDOW) -> list[tuple[int, ...]]:
    """The plan as rows (length, start, pieces, container, each, offset, tier, window, containers); piece r of a segment lies in its container + r // each."""
    found = sorted(containers(windows(histogram, capacity, least), capacity), key=lambda c: -c.cost)
    total = sum(c.count for c in found)
    used: dict[int, int] = {}
    rows, first = [], 0
    for c in found:
        at = 0
        for w, times in c.windows:
            for _ in range(times):
                start_of_window = at
                for length, n in w.items:
                    start = used.get(length, 0)
                    rows.append((length, start, n * c.count, first, n, at, w.tier, start_of_window, total))
                    used[length] = start + n * c.count
                    at += n * length
        first += c.count
    return rows


def piece_lengths(sizes: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """(target, capacity, doc_id, piece_no, first_token, length): documents for every target, cut only where they are longer than the capacity."""
    both = sizes.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("target"), F.lit(c).alias("capacity")) for i, c in targets]))).select("doc_id", "n_tokens", "t.*")
    numbered = both.withColumn("piece_no", F.explode(F.expr("sequence(0L, greatest((n_tokens + capacity - 1) div capacity, 1L) - 1)")))
    return numbered.select("target", "capacity", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("length"))


def _packed(sizes: DataFrame, listed: list[tuple[str, int]], group_size: int, blocks: int, least: int, bars: int) -> DataFrame:
    spark = sizes.sparkSession
    pieces = piece_lengths(sizes, [(i, c) for i, (_, c) in enumerate(listed)])
    # Units of a histogram: tokens, or a few of them where the capacity is very large. A piece of the whole capacity has all units.
    grain = F.ceil(F.col("capacity") / bars).cast("bigint")
    units = F.least(F.ceil(F.col("length") / grain), F.floor(F.col("capacity") / grain)).cast("bigint")
    pieces = pieces.withColumn("units", units)

    def pack_target(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        unit = -(-capacity // bars)
        made = plan(dict(zip(rows["units"].tolist(), rows["n"].tolist())), capacity // unit, max(least // unit, 1))
        out = pd.DataFrame(made, columns=["length", "start", "pieces", "container", "each", "offset", "tier", "window", "containers"])
        out.insert(0, "target", int(rows["target"].iloc[0]))
        return out.astype("int64").astype({"target": "int32", "tier": "int32"})

    histogram = pieces.groupBy("target", "capacity", "units").agg(F.count(F.lit(1)).alias("n"))  # at most the capacity's or MOST_BARS rows a target
    segments = written(histogram.groupBy("target").applyInPandas(pack_target, SEGMENTS), "packing-plan")

    # Numbers of the pieces within their length; empty ones go round the containers.
    spread = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)))
    numbered = row_numbers(spread, ["target", "units"], "block", ["doc_id", "piece_no"], "number").drop("block").withColumn("cell", F.shiftright("number", CELL_BITS))
    cells = segments.select("target", F.col("length").alias("units"), "start", "pieces", "container", "each", "offset", "tier", "window", F.explode(F.sequence(F.shiftright("start", CELL_BITS), F.shiftright(F.col("start") + F.col("pieces") - 1, CELL_BITS))).alias("cell"))
    # The exchange shows the true size of the cells, which Spark would take for that of the few segments, before anything is broadcast.
    cells = cells.repartition("target", "units", "cell")
    inside = (F.col("number") >= F.col("start")) & (F.col("number") < F.col("start") + F.col("pieces"))
    placed = numbered.where("units > 0").join(cells, ["target", "units", "cell"]).where(inside)
    r = F.col("number") - F.col("start")
    placed = placed.select("target", "capacity", "doc_id", "piece_no", "first_token", "length", (F.col("container") + F.expr("(number - start) div each")).alias("container_id"), "tier", (F.col("offset") + r % F.col("each") * F.col("units")).alias("at"), F.col("window").alias("window_at"))
    kinds = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(listed)], "target int, container_kind string, of bigint")
    counts = segments.groupBy("target").agg(F.max("containers").alias("containers"))
    kinds = kinds.join(counts, "target", "left").select("target", "container_kind", F.coalesce("containers", F.lit(0)).alias("containers"), F.greatest(F.ceil(F.coalesce("containers", F.lit(0)) / group_size), F.lit(1)).alias("groups"), F.ceil(F.col("of") / bars).cast("bigint").alias("grain"))
    kinds = F.broadcast(kinds)  # at most MOST_TARGETS rows
    zero = F.lit(0).cast("bigint")
    empty = numbered.where("units <= 0").join(kinds.select("target", "containers"), "target").select("target", "capacity", "doc_id", "piece_no", "first_token", "length", (F.col("number") % F.greatest("containers", F.lit(1))).alias("container_id"), F.lit(None).cast("int").alias("tier"), zero.alias("at"), zero.alias("window_at"))
    turn = F.expr("container_id % groups")
    group = F.when(F.expr("container_id div groups % 2 = 0"), turn).otherwise(F.col("groups") - 1 - turn)
    return placed.unionByName(empty).join(kinds, "target").select(
        "container_kind", F.col("capacity").alias("capacity_tokens"), "container_id", group.alias("step_group"), "tier",
        "doc_id", "piece_no", "first_token", F.col("length").alias("n_tokens"), (F.col("at") * F.col("grain")).alias("position"), (F.col("window_at") * F.col("grain")).alias("window_position"),
    )


def pack(sizes: DataFrame, pack_targets: DataFrame, group_size: int = GROUP_SIZE, blocks: int | None = None, least_window: int = LEAST_WINDOW, bars: int = MOST_BARS) -> DataFrame:
    """sizes (doc_id, n_tokens) packed for every target.

    Returns (container_kind, capacity_tokens, container_id, step_group, tier,
    doc_id, piece_no, first_token, n_tokens, position, window_position): a
    row per piece, with its first token in the document, its place in the
    container, and tier and place of the window it lies in (no tier if empty).
    """
    spark = sizes.sparkSession
    blocks = blocks or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = [(r[0], r[1]) for r in pack_targets.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("container_kind", "capacity_tokens").collect()]
    lots = [listed[i : i + MOST_TARGETS] for i in range(0, len(listed), MOST_TARGETS)]
    made = [_packed(sizes, lot, group_size, blocks, least_window, bars) for lot in lots]
    if not made:
        made = [_packed(sizes.limit(0), [("", 1)], group_size, blocks, least_window, bars)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


TARGET = ["container_kind", "capacity_tokens"]


def packing_report(packed: DataFrame) -> DataFrame:
    """Per target: containers, tokens, share of the space used, and how evenly cost is spread over the step groups."""
    filled = packed.groupBy(*TARGET, "step_group", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    groups = filled.groupBy(*TARGET, "step_group").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("cost").alias("cost"))
    return groups.groupBy(*TARGET).agg(
        F.sum("containers").alias("containers"), F.sum("tokens").alias("tokens"), F.max("fullest").alias("fullest"),
        (F.sum("tokens") / (F.sum("containers") * F.col("capacity_tokens"))).alias("used_share"),
        F.count(F.lit(1)).alias("step_groups"), (F.max("cost") / F.avg("cost")).alias("dearest_group"),
    )


def tier_report(packed: DataFrame) -> DataFrame:
    """Per target and tier: windows, tokens in them, and the share of the windows that is used."""
    filled = packed.where("tier is not null").groupBy(*TARGET, "tier", "container_id", "window_position").agg(F.sum("n_tokens").alias("tokens"))
    size = F.floor(F.col("capacity_tokens") / F.pow(F.lit(2), F.col("tier")))
    return filled.groupBy(*TARGET, "tier").agg(F.count(F.lit(1)).alias("windows"), F.sum("tokens").alias("tokens")).withColumn("used_share", F.col("tokens") / (F.col("windows") * size))


def packing_faults(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per target, what must be 0: tokens missing or there twice, containers over their capacity, pieces that overlap, and documents split without need."""
    pieces = packed.groupBy(*TARGET, "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("piece_no").alias("pieces"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))
    documents = pieces.join(whole, "doc_id", "right").groupBy(*TARGET).agg(
        F.sum(F.abs(F.coalesce("tokens", F.lit(0)) - F.col("n_tokens"))).alias("tokens_off"), F.count_if((F.col("pieces") > 1) & (F.col("longest") <= F.col("capacity_tokens"))).alias("needless_splits"),
    )
    inside = packed.where("n_tokens > 0").groupBy(*TARGET, "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("position") + F.col("n_tokens")).alias("end"), F.count_distinct("position").alias("places"), F.count(F.lit(1)).alias("n"))
    full = inside.groupBy(*TARGET).agg(F.count_if(F.greatest("tokens", "end") > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("places") != F.col("n")) | (F.col("end") < F.col("tokens"))).alias("overlapping"))
    return documents.join(full, TARGET, "full").select(*TARGET, "tokens_off", "needless_splits", "overfull", "overlapping")


def pack_documents(documents: DataFrame, pack_targets: DataFrame, sizes: DataFrame | None = None, **options) -> DataFrame:
    """pack() of documents by their tokens."""
    return pack(token_sizes(documents) if sizes is None else sizes, pack_targets, **options)


def token_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens), written once: the histogram and the assignment both read them."""
    from elemlake.llm.tokens import with_tokens

    return written(with_tokens(documents.select("doc_id", "text")).select("doc_id", "n_tokens"), "token-sizes")
