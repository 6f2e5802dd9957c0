from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from elemlake.llm.packing import containers, pack, packing_faults, packing_report, plan, tier_report, tiers_of, windows


def test_tiers():
    assert tiers_of(2048) == [2048, 1024, 512, 256, 128] and tiers_of(100) == [100] and tiers_of(1) == [1] and tiers_of(9, 2) == [9, 4, 2]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 64).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 40), max_size=20))), st.integers(1, 20))
def test_every_tier_is_packed_and_everything_placed_once(case, least):
    capacity, histogram = case
    sizes = tiers_of(capacity, least)
    kinds = windows(histogram, capacity, least)
    placed = defaultdict(int)
    for w in kinds:
        shorter = sizes[w.tier + 1] if w.tier + 1 < len(sizes) else 0
        assert 0 < w.used <= sizes[w.tier] and w.count > 0
        # A window is opened by a piece of its tier; what fills it comes from the same or a shorter one.
        assert shorter < w.items[0][0] <= sizes[w.tier] and all(length <= w.items[0][0] for length, _ in w.items)
        for length, n in w.items:
            placed[length] += n * w.count
    assert dict(placed) == {k: n for k, n in histogram.items() if n}
    made = containers(kinds, capacity)
    assert all(0 < c.used <= capacity and c.count > 0 for c in made)
    seen = defaultdict(int)
    for c in made:
        for w, times in c.windows:
            seen[id(w)] += times * c.count
    assert dict(seen) == {id(w): w.count for w in kinds}
    # The plan numbers every piece of every length once, and nothing overlaps in a container.
    numbers, space = defaultdict(list), defaultdict(list)
    for length, start, pieces, container, each, offset, _tier, _window, total in plan(histogram, capacity, least):
        numbers[length].append((start, start + pieces))
        for r in range(pieces):
            space[container + r // each].append((offset + r % each * length, length))
        assert total == sum(c.count for c in made)
    for length, spans in numbers.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(space) == list(range(sum(c.count for c in made)))
    for items in space.values():
        end = 0
        for at, n in sorted(items):
            assert at == end  # back to back
            end += n
        assert end <= capacity


@pytest.fixture(scope="module")
def sizes():
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 7, 7, 7, rng.randint(1, 300), int(rng.paretovariate(1) * 50)])) for i in range(3000)]
    return [*rows, (5000, 100_000), (5001, 512), (5002, 513), (5003, 1024)]


def test_pack(spark, sizes):
    docs = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("block", F.lit("clash"))
    targets = spark.createDataFrame([("short", 512), ("long", 2048), ("long", 2048), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    packed = pack(docs.select("doc_id", "n_tokens"), targets, group_size=8, blocks=5)
    rows = packed.collect()
    assert {r.container_kind for r in rows} == {"short", "long"}
    for kind, capacity in (("short", 512), ("long", 2048)):
        mine = [r for r in rows if r.container_kind == kind]
        pieces, inside = defaultdict(list), defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append((r.piece_no, r.first_token, r.n_tokens))
            inside[r.container_id].append((r.position, r.n_tokens))
            assert r.capacity_tokens == capacity
            assert (r.tier is None) == (r.n_tokens == 0) and (r.tier is None or r.window_position <= r.position and r.position + r.n_tokens <= r.window_position + capacity // 2**r.tier)
        for doc, n in sizes:
            got = sorted(pieces[doc])
            assert sum(x[2] for x in got) == n and (len(got) == 1) == (n <= capacity)
            assert [x[1] for x in got] == [capacity * i for i in range(len(got))]
        for items in inside.values():
            end = 0
            for at, n in sorted(x for x in items if x[1]):
                assert at == end  # back to back, nothing overlaps
                end += n
            assert end <= capacity
        total = sum(n for _, n in sizes)
        assert sorted(inside) == list(range(len(inside))) and total / (len(inside) * capacity) > 0.99
        groups = defaultdict(set)
        for r in mine:
            groups[r.step_group].add(r.container_id)
        assert max(map(len, groups.values())) - min(map(len, groups.values())) <= 1


def test_reports_and_empty(spark, sizes):
    docs = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([("short", 512)], "container_kind string, capacity_tokens int")
    packed = pack(docs, targets)
    report = packing_report(packed).first()
    assert report.tokens == sum(n for _, n in sizes) and report.fullest <= 512 and report.used_share > 0.99
    tiers = {r.tier: r for r in tier_report(packed).collect()}
    assert sorted(tiers) == [0, 1, 2] and sum(r.tokens for r in tiers.values()) == report.tokens and all(0.9 < r.used_share <= 1 for r in tiers.values())
    assert tuple(packing_faults(packed, docs).first()) == ("short", 512, 0, 0, 0, 0)
    assert pack(docs.limit(0), targets).count() == 0 and pack(docs, targets.limit(0)).count() == 0
    assert pack(docs.where("n_tokens = 0").limit(3), targets).count() == 3


def test_coarse_units(spark, sizes):
    """A capacity over the histogram's bars: nothing is lost or overlaps, and little space is."""
    docs = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    targets = spark.createDataFrame([("long", 2047), ("odd", 1000)], "container_kind string, capacity_tokens int")
    packed = pack(docs, targets, bars=300)
    assert sorted(tuple(r)[2:] for r in packing_faults(packed, docs).collect()) == [(0, 0, 0, 0)] * 2
    assert all(r.used_share > 0.93 for r in packing_report(packed).collect())


def test_tokens_are_those_of_the_tokenizer(spark):
    from elemlake.llm.tokens import encoder, tokenizer_dir, with_tokens

    texts = ["", None, "one two", "naïve Привет\n\n  x", "a" * 20000]
    got = {r.text: r.n_tokens for r in with_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    own = encoder(f"{tokenizer_dir(spark)}/byte_bpe_50k.tiktoken")
    for t in texts:
        ids = own.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "") and got[t] == len(ids)
