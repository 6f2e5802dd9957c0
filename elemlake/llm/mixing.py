"""Mixing sources to target weights with a low-discrepancy schedule.

A mix is a sequence of slots of equal token length. Slot i takes the point
frac(i * golden ratio) and the source in whose stretch of the cumulative
weights it falls; any run of slots then holds each source close to its
weight. The slots of a source are ranked. The source's documents, shuffled
anew for every repetition, are laid end to end and cut into blocks of exactly
the slot's length; block r fills the source's slot of rank r. A document longer than what is left
of a block goes on in the source's next slot: every row names the tokens of the document that it takes.

A mix ends before the first slot whose source has no tokens left, so every
slot is filled and the shares are the schedule's; only the very last block of
a source can be short. With run_dry, or a given total_tokens, it goes on
until every source is used up, or to the total, without the slots of sources that have run dry,
and the report shows the shares reached.
Weights of sources without any document are shared out among the others, and the report names them.

Defined results: weights of one (mix, source) listed twice add up and the smaller
max_repeats holds; null or non-positive weights count as 0, a null
max_repeats as 1; documents without a source, text or token belong to no mix;
documents of equal id are one document with the largest size; empty tables
give no rows.

Group sizes: running sums and ranks are taken in hash blocks, so a source
with a third of all documents is spread; slots meet stretches and blocks meet slots by keys
that no source holds alone. Only sources per mix are counted in one window: they are configuration.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elemlake.plans.skew import row_numbers, sums_before
from elemlake.plans.workspace import written

#: Tokens of one slot.
BLOCK_TOKENS = 512
#: Cells of the unit interval in which points look for their stretch, slots that are ranked together (as a power of two), and spare slots.
CELLS, RANK_BITS, SPARE = 4096, 14, 8

#: Rows of configuration that may be broadcast.
MOST_BROADCAST = 500_000

GOLDEN = (math.sqrt(5) - 1) / 2
MIXED = "mix_name string, slot bigint, source string, doc_id bigint, use_no int, first_token bigint, n_tokens bigint"


def weights_of(mix_targets: DataFrame) -> DataFrame:
    """(mix_name, source, weight, repeats): each listed source once."""
    listed = mix_targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source")
    return listed.agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))


def stretches_of(mix_targets: DataFrame, totals: DataFrame, total_tokens: int | None, block_tokens: int, run_dry: bool) -> DataFrame:
    """(mix_name, source, target, low, high, source_tokens, repeats, blocks, slots) of the sources that have documents; slots is how many the mix is planned with."""
    able = weights_of(mix_targets).join(totals, "source").where("weight > 0 and source_tokens > 0 and repeats > 0")
    whole = Window.partitionBy("mix_name")
    upto = whole.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    shares = able.withColumn("target", F.col("weight") / F.sum("weight").over(whole)).withColumn("high", F.sum("weight").over(upto) / F.sum("weight").over(whole))
    order = whole.orderBy("source")
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("high", F.when(F.lead("high").over(order).isNull(), 2.0).otherwise(F.col("high")))
    reach = F.col("repeats") * F.col("source_tokens") / F.col("target")
    total = F.lit(float(total_tokens)) if total_tokens is not None else (F.max(reach) if run_dry else F.min(reach)).over(whole)
    shares = shares.withColumn("slots", F.ceil(total / block_tokens).cast("bigint") + (0 if total_tokens is not None else SPARE))
    return shares.select("mix_name", "source", "target", "low", "high", "source_tokens", "repeats", F.ceil(F.col("repeats") * F.col("source_tokens") / block_tokens).cast("bigint").alias("blocks"), "slots")


def slot_sources(stretches: DataFrame) -> DataFrame:
    """(mix_name, slot, source, rank): the schedule. The slots of all mixes come from one plan, whatever their number."""
    mixes = stretches.select("mix_name", "slots").distinct()
    chunks = mixes.select("mix_name", "slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("slots") - 1, RANK_BITS))).alias("chunk")).where("slots > 0")
    first = F.shiftleft("chunk", RANK_BITS)
    spread = chunks.repartition("mix_name", "chunk")
    slots = spread.select("mix_name", "chunk", F.explode(F.sequence(first, F.least(first + ((1 << RANK_BITS) - 1), F.col("slots") - 1))).alias("slot"))
    # The point of slot i, in two steps to keep its digits for large i.
    step = 1 << 20
    coarse = math.fmod(step * GOLDEN, 1.0)
    points = slots.withColumn("x", F.expr(f"pmod((slot div {step}) * double({coarse!r}) + (slot % {step}) * double({GOLDEN!r}) + 0.5d, 1.0d)")).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    cells = stretches.select("mix_name", "source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS).cast("int"), F.lit(CELLS - 1)))).alias("cell"))
    # Spark takes the slots for as few as the mixes they are made from, and would broadcast them. What may be is the side with a bound: a mix has CELLS cells and one more per source.
    few = mixes.count() * CELLS + stretches.count() <= MOST_BROADCAST
    found = (points.join(F.broadcast(cells), ["mix_name", "cell"]) if few else points.hint("merge").join(cells, ["mix_name", "cell"])).where("x >= low and x < high").select("mix_name", "slot", "source", "chunk")
    return row_numbers(found, ["mix_name", "source"], "chunk", ["slot"], "rank").select("mix_name", "source", "rank", "slot")


def mix(sizes: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42, run_dry: bool = False) -> DataFrame:
    """sizes (doc_id, source, n_tokens) mixed: (mix_name, slot, source, doc_id, use_no, first_token, n_tokens), a row per piece of a document in a slot."""
    used = sizes.where("source is not null and doc_id is not null and n_tokens > 0").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    listed = mix_targets.select("source").where("source is not null").distinct()
    docs = written(used.join(listed, "source", "left_semi"), "mix-sizes")
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    stretches = written(stretches_of(mix_targets, totals, total_tokens, block_tokens, run_dry), "mix-stretches")
    schedule = written(slot_sources(stretches), "mix-slots").join(stretches.select("mix_name", "source", "blocks"), ["mix_name", "source"])
    ranked = schedule.where("rank < blocks").drop("blocks")
    if total_tokens is None and not run_dry:
        end = schedule.where("rank >= blocks").groupBy("mix_name").agg(F.min("slot").alias("end"))
        ranked = ranked.join(end, "mix_name", "left").where("end is null or slot < end").drop("end")

    # Documents: every repetition in an order of its own, laid end to end.
    wanted = F.ceil((F.col("target") * F.col("slots") + SPARE) * block_tokens / F.col("source_tokens"))
    epochs = stretches.select("mix_name", "source", "source_tokens", F.least(F.col("repeats").cast("bigint"), wanted).cast("int").alias("epochs"))
    uses = docs.join(epochs, "source").withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    uses = uses.withColumn("order", F.xxhash64("mix_name", "use_no", "doc_id", F.lit(seed))).withColumn("block", F.shiftright("order", 54))
    laid = sums_before(uses, ["mix_name", "source", "use_no"], "block", ["order", "doc_id"], "n_tokens", "before")
    laid = laid.withColumn("start", F.col("use_no") * F.col("source_tokens") + F.col("before"))
    first, last = (F.floor(F.col(c) / F.lit(block_tokens)).cast("bigint") for c in ("start", "end"))
    cut = laid.withColumn("end", F.col("start") + F.col("n_tokens") - 1).withColumn("rank", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("rank") * block_tokens, "start")
    high = F.least((F.col("rank") + 1) * block_tokens, F.col("end") + 1)
    pieces = cut.select("mix_name", "source", "doc_id", "use_no", "rank", (low - F.col("start")).alias("first_token"), (high - low).alias("n_tokens"))
    return pieces.join(ranked, ["mix_name", "source", "rank"]).select("mix_name", "slot", "source", "doc_id", "use_no", "first_token", "n_tokens")


def mix_report(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Target and reached share of every listed source: (mix_name, source, target_share, reached_share, tokens, uses, documents, most_uses); a use is a document in one repetition, whole or in part."""
    per_use = mixed.groupBy("mix_name", "source", "doc_id", "use_no").agg(F.sum("n_tokens").alias("tokens"))
    per_doc = per_use.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"))
    reached = per_doc.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    wanted = weights_of(mix_targets)
    all_ = reached.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    weights = wanted.groupBy("mix_name").agg(F.sum("weight").alias("all_w"))
    rows = wanted.join(weights, "mix_name").join(reached, ["mix_name", "source"], "left").join(all_, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("mix_name", "source", F.try_divide("weight", "all_w").alias("target_share"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("uses"), zero("documents"), zero("most_uses"))


def mix_documents(documents: DataFrame, mix_targets: DataFrame, sizes: DataFrame | None = None, **options) -> DataFrame:
    """mix() of documents by their tokens; only texts of listed sources are read through the tokenizer."""
    from elemlake.llm.tokens import with_tokens

    if sizes is None:
        listed = mix_targets.select("source").where("source is not null").distinct()
        asked = documents.select("doc_id", "source", "text").join(listed, "source", "left_semi")
        sizes = with_tokens(asked).select("doc_id", "source", "n_tokens")
    return mix(sizes, mix_targets, **options)
