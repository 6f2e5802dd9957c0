"""The queries of the text operators, and SQL where one can say the result.

Tokenizing and character folding are not expressible; tests/llm checks them. SQL checks that packing loses,
overfills and splits nothing, and the shares of a mix by characters, whose sizes it knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.llm.confusables import confusable_tokens, consistent_form, look_alike_classes, look_alike_pairs
from elemlake.llm.mixing import BLOCK_TOKENS, GOLDEN, SPARE, mix, mix_documents, mix_report
from elemlake.llm.packing import pack, pack_documents, packing_faults, packing_report, tier_report, token_sizes
from elemlake.tables import table


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), table(spark, sf, "pack_targets"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(p7_pack(spark, sf))


def p7_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return tier_report(p7_pack(spark, sf))


def p7_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens lost or doubled, containers over their capacity or with overlaps, documents split without need: none of any target."""
    sizes = token_sizes(table(spark, sf, "documents"))
    return packing_faults(pack(sizes, table(spark, sf, "pack_targets")), sizes)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(p8_mix(spark, sf), table(spark, sf, "mix_targets"))


def p8_shares_dry(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached if every source is used up to its repeats."""
    return mix_report(mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), run_dry=True), table(spark, sf, "mix_targets"))


def p8_shares_by_characters(spark: SparkSession, sf: str) -> DataFrame:
    """The mix with characters for tokens."""
    sizes = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    targets = table(spark, sf, "mix_targets")
    return mix_report(mix(sizes, targets), targets).select("mix_name", "source", F.round("target_share", 9).alias("target_share"), F.round("reached_share", 9).alias("reached_share"), "tokens")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf, "documents").select("doc_id", "text"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_classes(table(spark, sf, "documents").select("doc_id", "text"))


def p9_consistent(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", consistent_form("text").alias("text"), confusable_tokens("text").alias("c"))
    return rows.select("doc_id", "text", F.col("c.mixed").alias("mixed_tokens"), F.col("c.whole").alias("whole_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p7_pack, p7_report, p7_tiers, p7_faults, p8_mix, p8_shares, p8_shares_dry, p8_shares_by_characters, p9_found, p9_classes, p9_consistent)
}

_STEP = 1 << 20

ORACLES: dict[str, str] = {
    "p7_faults": "select distinct container_kind, capacity_tokens, 0 as tokens_off, 0 as needless_splits, 0 as overfull, 0 as overlapping from pack_targets where capacity_tokens > 0",
    "p8_shares_by_characters": f"""
with listed as (select mix_name, source, sum(greatest(coalesce(target_weight, 0), 0)) as weight, min(coalesce(max_repeats, 1)) as repeats from mix_targets where mix_name is not null and source is not null group by 1, 2),
sized as (select source, sum(n) as source_tokens from (select doc_id, source, max(n_chars) as n from documents where source is not null and doc_id is not null and n_chars > 0 group by 1, 2) group by 1),
able as (select l.*, s.source_tokens from listed l join sized s using (source) where weight > 0 and repeats > 0),
shares as (
  select *, weight / sum(weight) over m as target, sum(weight) over u / sum(weight) over m as high, ceil(repeats * source_tokens / {BLOCK_TOKENS}) as blocks
  from able window m as (partition by mix_name), u as (partition by mix_name order by source rows unbounded preceding)),
placed as (
  select *, coalesce(lag(high) over o, 0) as low, case when lead(high) over o is null then 2 else high end as top, cast(ceil(min(repeats * source_tokens / target) over m / {BLOCK_TOKENS}) as bigint) + {SPARE} as slots
  from shares window m as (partition by mix_name), o as (partition by mix_name order by source)),
slots as (select mix_name, unnest(range(slots)) as slot from (select distinct mix_name, slots from placed)),
points as (select *, ((slot // {_STEP}) * {GOLDEN * _STEP % 1.0!r}::double + (slot % {_STEP}) * {GOLDEN!r}::double + 0.5::double) % 1.0::double as x from slots),
ranked as (select mix_name, slot, source, blocks, row_number() over (partition by mix_name, source order by slot) - 1 as rank from points p join placed s using (mix_name) where p.x >= s.low and p.x < s.top),
ends as (select mix_name, min(slot) as stop from ranked where rank >= blocks group by 1),
counted as (select mix_name, source, count(*) as n from ranked left join ends using (mix_name) where stop is null or slot < stop group by 1, 2),
filled as (select c.mix_name, c.source, least(n * {BLOCK_TOKENS}, repeats * source_tokens) as tokens from counted c join placed using (mix_name, source))
select l.mix_name, l.source, round(l.weight / sum(l.weight) over (partition by l.mix_name), 9) as target_share, round(coalesce(tokens / sum(tokens) over (partition by l.mix_name), 0), 9) as reached_share, cast(coalesce(tokens, 0) as bigint) as tokens
from listed l left join filled using (mix_name, source)""",
}
