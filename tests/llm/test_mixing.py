from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from elemlake.llm.mixing import mix, mix_report

TARGETS = "mix_name string, source string, target_weight double, max_repeats int"


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.choice([rng.randint(1, 400), rng.randint(1, 60), 3000 if i % 97 == 0 else 5])) for i in range(4000)] + [(9000 + i, "tiny", 50) for i in range(20)] + [(1, "a", 1), (None, "a", 5), (7777, None, 5), (7778, "a", 0), (7779, "d", None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "'x' as block", "1 as rank")


def shares(mixed, targets):
    return {(r.mix_name, r.source): r for r in mix_report(mixed, targets).collect()}


def lengths(sizes):
    out = defaultdict(int)
    for r in sizes.where("source is not null and doc_id is not null and n_tokens > 0").collect():
        out[r.source, r.doc_id] = max(out[r.source, r.doc_id], r.n_tokens)
    return out


def test_shares_blocks_and_repeats(spark, sizes):
    targets = spark.createDataFrame([("m", "a", 5.0, 1), ("m", "b", 2.0, 3), ("m", "c", 1.0, None), ("m", "absent", 2.0, 4), ("m", None, 1.0, 1), ("n", "tiny", 1.0, 8), ("n", "b", 3.0, 2), ("n", "c", -1.0, 2), ("n", "b", 0.0, 2)], TARGETS)
    rows = mix(sizes, targets, block_tokens=64).collect()
    mixed = spark.createDataFrame(rows)
    found = shares(mixed, targets)
    for (name, source), want in {("m", "a"): 5 / 8, ("m", "b"): 2 / 8, ("m", "c"): 1 / 8, ("n", "tiny"): 1 / 4, ("n", "b"): 3 / 4}.items():
        assert abs(found[name, source].reached_share - want) < 0.01
    assert found["m", "absent"].reached_share == 0 and found["m", "absent"].target_share == 0.2 and found["n", "c"].uses == 0
    most = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 1, ("n", "tiny"): 8, ("n", "b"): 2}
    assert all(found[k].most_uses <= n for k, n in most.items()) and found["n", "tiny"].most_uses == 8
    # Every slot is there and holds one block of one source; a source's last one alone may be short.
    size = lengths(sizes)
    for name in ("m", "n"):
        slots = defaultdict(list)
        for r in rows:
            if r.mix_name == name:
                slots[r.slot].append(r)
        assert sorted(slots) == list(range(len(slots))) and all(len({r.source for r in x}) == 1 for x in slots.values())
        short = Counter(x[0].source for x in slots.values() if sum(r.n_tokens for r in x) != 64)
        assert all(n == 1 for n in short.values())
    # Of one use of a document every token is taken once, in order, but for what is left over at the end of the mix.
    uses = defaultdict(list)
    for r in rows:
        uses[r.mix_name, r.source, r.doc_id, r.use_no].append((r.first_token, r.n_tokens, r.slot))
    cut = Counter()
    for (name, source, doc, _), pieces in uses.items():
        pieces.sort()
        assert all(a[0] + a[1] == b[0] and a[2] < b[2] for a, b in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        whole = sum(n for _, n, _ in pieces)
        assert whole <= size[source, doc]
        cut[name, source] += whole < size[source, doc]
    assert max(cut.values()) <= 1


def test_any_stretch_is_mixed(spark, sizes):
    targets = spark.createDataFrame([("m", "a", 2.0, 1), ("m", "b", 1.0, 2)], TARGETS)
    tokens = defaultdict(lambda: defaultdict(int))
    for r in mix(sizes, targets, block_tokens=256).collect():
        tokens[r.slot][r.source] += r.n_tokens
    last = max(tokens)
    assert last > 300 and set(tokens) == set(range(last + 1))
    for low in range(0, last - 99, 17):
        a, b = (sum(tokens[i][s] for i in range(low, low + 100)) for s in "ab")
        assert abs(a / (a + b) - 2 / 3) < 0.02


def test_a_given_total_and_running_dry(spark, sizes):
    targets = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "tiny", 1.0, 2)], TARGETS)
    found = shares(mix(sizes, targets, total_tokens=100_000, block_tokens=64), targets)
    assert found["m", "tiny"].tokens == 2000 and found["m", "tiny"].most_uses == 2 and abs(found["m", "a"].tokens - 50_000) < 2000
    size = lengths(sizes)
    dry = shares(mix(sizes, targets, block_tokens=64, run_dry=True), targets)
    assert dry["m", "a"].tokens == sum(n for (s, _), n in size.items() if s == "a") and dry["m", "tiny"].tokens == 2000 and dry["m", "a"].most_uses == 1


def test_empty(spark, sizes):
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert mix(sizes.limit(0), targets).count() == 0 and mix(sizes, targets.limit(0)).count() == 0


def test_same_result_again(spark, sizes, monkeypatch):
    targets = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "b", 1.0, 1)], TARGETS)
    once, again = (sorted(map(tuple, mix(d, targets).collect())) for d in (sizes, sizes.repartition(3)))
    assert once == again
    monkeypatch.setattr("elemlake.llm.mixing.MOST_BROADCAST", 0)  # more configuration than is broadcast
    assert sorted(map(tuple, mix(sizes, targets).collect())) == once
