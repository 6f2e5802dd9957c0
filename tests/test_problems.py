"""The data-pipeline operators on small tables: nulls, empty and repeated rows, ties, clashing columns, hot groups, and brute force."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from elemlake.operators.attribute_pivot import long_form, unfilled_cells, wide_columns, wide_table
from elemlake.operators.change_feed import current_attributes
from elemlake.operators.hierarchy import element_hierarchy, hierarchy, subtree_sums
from elemlake.operators.references import contiguous_runs, orphan_references
from elemlake.operators.satellites import append_satellites, attributes_as_of, changed_rows, element_periods, satellites, version_rows
from elemlake.operators.snapshot_diff import apply_snapshot, compact, snapshot_changes
from elemlake.plans.skew import block_of, carry_forward, cut_groups, cut_points, long_groups, row_numbers, sums_before

LINES = "source string, elem_no int, kind string, name string, attr_no int, key string, value string"
LAYOUT = "noun string, attr string, attr_hash bigint, word_offset int, bit_index int, attr_type string, default_tag string, is_expr boolean"
VERSIONS = "dbnum int, ref0 bigint, ref1 bigint, sesno int, byte_offset bigint, noun string, noun_hash bigint, owner_ref0 bigint, owner_ref1 bigint, name string, children array<struct<ref0:bigint,ref1:bigint>>, deleted boolean"
ATTRS = "dbnum int, ref0 bigint, ref1 bigint, sesno int, kind string, key string, tag string, v_int bigint, v_double double, v_bool boolean, v_str string, v_ints array<int>, v_doubles array<double>, v_strs array<string>, v_refs array<struct<ref0:bigint,ref1:bigint>>"
CHANGES = "change_id bigint, dbnum int, ref0 bigint, ref1 bigint, sesno int, op_no int, operation_type string, entity_type string, ts timestamp, details string"
SNAPSHOTS = "dbnum int, ses_no int, ref0 bigint, ref1 bigint, noun string, whole_attmap string, captured_at timestamp"
ENTRIES = "dbnum int, sesno int, page_no bigint, level int, ord int, ref0 bigint, ref1 bigint, child_pgno bigint, offset_words int, flag int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clashing(df):
    """The same table with columns named like the operators' own."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("entity", "block", "h", "hash", "at", "life", "step", "k", "m", "_value", "id", "parent", "removed", "in_run")])


# 1


@pytest.fixture(scope="module")
def layout(spark):
    types = {"N": "Integer", "R": "Real", "B": "Boolean", "P": "Position", "T": "Text", "E": "Enum", "F": "Reference"}
    data = [("PIPE", a, 1, 1, None, t, None, False) for a, t in types.items()] + [("VALV", "R", 1, 1, None, "Enum", None, False)]
    return spark.createDataFrame(data, LAYOUT)


@pytest.mark.parametrize(
    ("key", "values", "bad"),
    [
        ("n", ["7", " +007 ", None, "", "UNSET"], False), ("N", ["7", "8"], True), ("N", ["7O"], True), ("N", ["7.0"], True), ("N", ["9" * 60], False),
        ("R", ["1 m", "1000mm", "100CM", "1000.001"], False), ("R", ["1..2"], True), ("R", [".5"], True), ("R", ["5  mm"], True), ("R", ["1", "1.003"], True), ("R", ["1kPa", "1000 pascal"], False),
        ("B", ["t", "TRUE", "tru"], False), ("B", ["yes"], True), ("B", ["t", "f"], True), ("B", ["truee"], True),
        ("P", ["X 1 Y 2 Z 3", "U 3mm E 1 N 0.2cm"], False), ("P", ["X 1 Y 2"], True), ("P", ["X 1 X 2 Z 3"], True), ("P", ["X 1  Y 2 Z 3"], True), ("P", ["X 1 Y 2 Z 3", "X 1 Y 2 Z 4"], True),
        ("F", ["=1/2", "=1/2"], False), ("F", ["/A/B", "/A/C"], True), ("F", ["=1/"], True), ("F", ["/a b"], True), ("T", ["'a b'", "a b"], False), ("E", ["A", "B"], True), ("T", ["'"], False), ("Q", ["anything", "else"], False),
    ],
)
def test_cells(spark, layout, key, values, bad):
    lines = spark.createDataFrame([("s", 1, "pipeline", None, i, key, v) for i, v in enumerate(values)], LINES)
    assert (unfilled_cells(lines, layout, buckets=2).count() == 1) is bad


def test_wide_rows(spark, layout):
    data = [("s", 1, "PIPE", None, 1, "N", "5"), ("s", 1, "PIPE", None, 2, "P", "X 1 Y 2 Z 3"), ("s", 1, "PIPE", None, 3, "R", "2m"), ("s", 2, "valve", None, 1, "R", "LONG"), ("s", 2, "valve", None, 1, ":Z", "1"), (None, 3, None, None, None, None, None)]
    wide = wide_table(clashing(spark.createDataFrame(data * 2, LINES)), layout, block_size=2, buckets=3)
    assert {c.name for c in wide_columns(layout)} == {"N", "R_number", "R_text", "B", "P", "T", "E", "F"}
    got = {(r.source, r.elem_no): r for r in wide.collect()}
    assert got["s", 1].N == 5 and got["s", 1].P == [1.0, 2.0, 3.0] and got["s", 1].R_number == 2000.0 and got["s", 1].R_text is None
    assert got["s", 2].R_text == "LONG" and got["s", 2].n_unlisted == 1 and got[None, 3].unfilled == [] and len(got) == 3
    assert wide_table(spark.createDataFrame([], LINES), layout, buckets=2).count() == 0
    # Integers that 64 bits can't hold, or a real can't tell apart.
    big = ["9007199254740992", "9007199254740993", "9" * 40, "+0" + "9" * 40, "-0", "00"]
    lines = spark.createDataFrame([("s", n, "PIPE", None, i, "N", v) for n, i, v in [(1, 1, big[0]), (1, 2, big[1]), (2, 1, big[2]), (2, 2, big[3]), (3, 1, big[4]), (3, 2, big[5]), (4, 1, big[1])]], LINES)
    got = {r.elem_no: (r.N, r.unfilled, r.beyond) for r in wide_table(lines, layout, buckets=2).collect()}
    assert got == {1: (None, ["N"], []), 2: (None, [], ["N"]), 3: (0, [], []), 4: (int(big[1]), [], [])}
    assert wide_table(spark.createDataFrame(data, LINES), spark.createDataFrame([], LAYOUT), buckets=2).count() == 3


def test_many_blocks_of_attributes(spark):
    """Every block reads its own partition of the cells, and lots of blocks meet in a tree of joins."""
    names = [f"A{i:04d}" for i in range(1000)]
    layout = spark.createDataFrame([("PIPE", a, 1, 1, None, "Integer" if i % 2 else "Text", None, False) for i, a in enumerate(names)], LAYOUT)
    rng = random.Random(1)
    cells = {(e, a): rng.randrange(99) for e in range(20) for a in rng.sample(names, 30)}
    lines = spark.createDataFrame([("s", e, "pipe", None, 1, a.lower(), str(v)) for (e, a), v in cells.items()], LINES)
    found = long_form(wide_table(lines, layout, block_size=100, buckets=2, blocks_per_plan=3))
    assert {(r.elem_no, r.column): r.number if r.number is not None else r.text for r in found.collect()} == {(e, a): float(v) if int(a[1:]) % 2 else str(v) for (e, a), v in cells.items()}


# 2


def test_snapshots(spark):
    day = lambda d: datetime(2020, 1, d)
    data = [
        (1, 1, 1, 1, "A", '{"X": 1, "PGNO": 5, "N": null}', day(1)), (1, 1, 1, 1, "A", '{"X":1.0}', None), (1, 1, 1, 2, "A", '{"X": [1, 2.0]}', day(1)), (1, 1, 1, 3, "A", None, day(1)),
        (1, 5, 1, 1, "A", '{"PGNO": 6, "X": 1e0}', day(2)), (1, 5, 1, 2, "A", '{"X":[1.00,2,3]}', day(3)), (1, 5, 1, 2, "A", '{"X":[1,2]}', day(2)), (1, 5, 1, 4, "A", "broken", day(2)), (1, 5, None, 4, "A", "{}", day(2)),
        (1, 9, 1, 1, "A", '{"X": "1"}', day(4)), (1, 9, 1, 2, "A", '{"X":[1.00,2,3],"Y":true}', day(4)), (1, 9, 1, 4, "A", '{"Z": null}', day(4)),
        (2, 3, 7, 7, "A", "{}", day(1)),
    ]
    want = [(1, 5, 1, 2, "changed", "X"), (1, 5, 1, 3, "removed", ""), (1, 5, 1, 4, "added", ""), (1, 9, 1, 1, "changed", "X"), (1, 9, 1, 2, "changed", "Y")]
    for steps in (12, 1):
        found = snapshot_changes(clashing(spark.createDataFrame(data * 2, SNAPSHOTS)), buckets=3, steps_per_plan=steps)
        assert rows(found.select("dbnum", "ses_no", "ref0", "ref1", "diff_type", "attr")) == sorted(want, key=repr)
    assert snapshot_changes(spark.createDataFrame([], SNAPSHOTS), buckets=2).count() == 0
    # Delivery by delivery the changes are the same; databases need not be delivered together.
    index, found = None, []
    late = [(3, 8, 1, 1, "A", "{}", day(1)), (3, 9, 1, 1, "A", '{"Q":1}', day(1)), (3, 9, 1, 2, "A", "{}", day(1))]
    for lot in ([(1, 1), (2, 3)], [(1, 5), (3, 8)], [(3, 9)], [(1, 9)]):
        delivery = [x for x in [*data, *late] if x[:2] in lot]
        changes, index = apply_snapshot(index, clashing(spark.createDataFrame(delivery * 2, SNAPSHOTS)), buckets=3)
        found += rows(changes.select("dbnum", "ses_no", "ref0", "ref1", "diff_type", "attr"))
        if lot == [(3, 9)]:
            kept, index = index, compact(index)
            assert rows(index.records) == rows(kept.records) and index.values.count() == index.records.count()
    assert sorted(found, key=repr) == sorted([*want, (3, 9, 1, 1, "changed", "Q"), (3, 9, 1, 2, "added", "")], key=repr)
    # Values are kept only for records that were new or changed: 3 + 1 + 1, then 2 of database 1, two of 3, and 2 again.
    assert [t.where("entries is not null").count() for t in [*kept.tables, *index.tables]] == [4, 3, 2, 6, 2]


# 3


def attr(ses, key, ref1=1, **v):
    empty = {c: None for c in ("v_int", "v_double", "v_bool", "v_str", "v_ints", "v_doubles", "v_strs", "v_refs")} | v
    return (1, 1, ref1, ses, "att", key, "t", *empty.values())


def version(ses, deleted=False, ref1=1, at=0, owner=(0, 0), children=None, db=1, noun="PIPE"):
    return (db, 1, ref1, ses, at, noun, 1, *owner, None, children, deleted)


def test_periods(spark):
    attrs = [attr(1, "A", v_int=1), attr(1, "PGNO", v_int=9), attr(2, "A", v_double=1.0), attr(2, "B"), attr(3, "A", v_str="1"), attr(6, "A", v_str="1"), attr(7, "A", v_str="1"), attr(7, "L", v_doubles=[1.0, None]), attr(1, None, 2, v_bool=True)]
    versions = [version(1), version(2), version(3), version(4, True), version(5, True), version(6), version(7), version(8), version(1, ref1=2), version(9, True, at=1), version(9, False)]
    a, v = spark.createDataFrame(attrs * 2, ATTRS), spark.createDataFrame(versions * 2, VERSIONS)
    want = [(1, 1, 3), (1, 3, 4), (1, 6, 7), (1, 7, 8), (1, 8, 9), (2, 1, 0)]
    for x, y in ((a, v), (clashing(a), clashing(v))):
        assert rows(element_periods(satellites(x, y)).select("ref1", "from_sesno", "to_sesno")) == want
    # Built in two deliveries, the satellites are the same as at once.
    early = lambda d: d.where("sesno <= 3")
    whole = version_rows(a, v, ["A"])
    stored = changed_rows(early(whole))
    more = append_satellites(stored, whole)
    assert rows(stored.unionByName(more)) == rows(changed_rows(whole)) and more.count()
    # The satellites tell the values of any session, whichever attributes are the fast ones.
    for fast in ([], ["A"], ["A", "B", "L"], spark.createDataFrame([("A",), ("A",)], "key string")):
        built = changed_rows(version_rows(a, v, fast))
        for ses, known in {0: [], 1: [(1, "A", "1"), (2, None, "true")], 2: [(1, "A", "1"), (2, None, "true")], 5: [(2, None, "true")], 7: [(1, "A", '"1"'), (1, "L", "[1.0,null]"), (2, None, "true")], 8: [(2, None, "true")]}.items():
            assert rows(attributes_as_of(built, ses).select("ref1", "key", "value")) == sorted(known, key=repr)
    assert element_periods(satellites(spark.createDataFrame([], ATTRS), spark.createDataFrame([], VERSIONS))).count() == 0


# 4


def apply_plainly(ops):
    state, kinds = {}, {}
    for (r, s, o), (kind, details) in sorted(ops.items()):
        d = json.loads(details) if details else {}
        if kind == "Add":
            state[r] = {a: (s, o) for a in d.get("whole_attmap", {})}
        elif kind == "Deleted":
            state.pop(r, None)
        elif kind == "Modified" and r in state:
            for a in d.get("deleted_attrs", {}):
                state[r].pop(a, None)
            state[r] |= {a: (s, o) for a in [*d.get("added_attrs", {}), *d.get("modified_attrs", {})]}
    del kinds
    return sorted((1, r, a, *at) for r, attrs in state.items() for a, at in attrs.items())


def random_feed(seed, elements=12, n=400):
    rng, ops = random.Random(seed), {}
    for i in range(n):
        kind = rng.choice(["Add", "Modified", "Modified", "Modified", "Deleted", "None"])
        pick = lambda: rng.sample("ABCDEF", rng.randint(0, 3))
        d = {"whole_attmap": {a: 1 for a in pick()}} if kind == "Add" else {"added_attrs": {a: 2 for a in pick()}, "modified_attrs": {a: [1, None] for a in pick()}, "deleted_attrs": {a: 1 for a in pick()}}
        ops[rng.choice([1, rng.randint(1, elements)]), i // 7, i % 7] = (kind, json.dumps(d) if rng.random() < 0.95 else None)
    return ops


def feed_rows(ops, seed=0):
    data = [(i, 1, 1, r, s, o, k, None, None, d) for i, ((r, s, o), (k, d)) in enumerate(ops.items())]
    data += [(len(data) + i, *x[1:]) for i, x in enumerate(data) if i % 3 == 0]
    random.Random(seed).shuffle(data)
    return data


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feed(spark, seed):
    ops = random_feed(seed)
    changes = clashing(spark.createDataFrame(feed_rows(ops), CHANGES))
    got = current_attributes(changes, rows_per_block=(10_000, 60, 3)[seed - 1])
    assert rows(got.select("ref0", "ref1", "attr", "sesno", "op_no")) == sorted(apply_plainly(ops), key=repr)
    # The feed in two parts, the second upon the first's result.
    first, second = ({k: v for k, v in ops.items() if (k[1] < 30) is early} for early in (True, False))
    base = current_attributes(spark.createDataFrame(feed_rows(first), CHANGES))
    again = current_attributes(spark.createDataFrame(feed_rows(second), CHANGES), base)
    assert rows(again.select("ref0", "ref1", "attr", "sesno", "op_no")) == sorted(apply_plainly(ops), key=repr)


def test_feed_edges(spark):
    assert current_attributes(spark.createDataFrame([], CHANGES)).count() == 0
    data = [(1, 1, 1, 1, None, None, "Add", None, None, '{"whole_attmap":{"A":1}}'), (2, 1, 1, 1, 1, 1, " modified", None, None, "broken"), (3, 1, None, 1, 1, 2, "Add", None, None, "{}"), (4, 1, 1, 2, 1, 3, "what", None, None, None), (5, 1, 1, 1, 1, 4, "MODIFIED", None, None, '{"deleted_attrs":{"A":1},"added_attrs":{"A":"v"}}')]
    assert rows(current_attributes(spark.createDataFrame(data, CHANGES)).select("ref1", "attr", "value", "sesno", "op_no")) == [(1, "A", '"v"', 1, 4)]


def test_feed_nulls_and_base(spark):
    add = lambda i, r, s, o, kind="Add", d='{"whole_attmap":{"A":1,"B":1}}': (i, 1, 1, r, s, o, kind, None, None, d)
    names = ["ref1", "attr", "sesno", "op_no"]
    first = current_attributes(spark.createDataFrame([add(1, 1, 5, None), add(2, 2, None, None), add(3, 3, None, 0), add(4, 4, 0, 0)], CHANGES))
    places = {1: (5, None), 2: (None, None), 3: (None, 0), 4: (0, 0)}
    assert rows(first.select(*names)) == sorted([(r, a, *at) for r, at in places.items() for a in "AB"], key=repr)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Null sesno and op_no in the later feed come after the base, and are the writer's own.
        later = [add(5, 1, None, None, "Modified", '{"added_attrs":{"A":2}}'), add(6, 4, 6, None, "Modified", '{"added_attrs":{"B":2}}')]
        again = current_attributes(spark.createDataFrame(later, CHANGES), first)
        want = {(r, a): at for r, at in places.items() for a in "AB"} | {(1, "A"): (None, None), (4, "B"): (6, None)}
        assert rows(again.select(*names)) == sorted([(r, a, *at) for (r, a), at in want.items()], key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


# 5


def test_references(spark):
    kid = lambda *refs: [(1, r) for r in refs]
    versions = [version(1, ref1=1, children=kid(2, 5000, 77)), version(2, ref1=1, children=[]), version(3, ref1=2, owner=(1, 1)), version(4, True, ref1=2, owner=(9, 9)), version(5, ref1=5000, owner=(1, 2)), version(2, ref1=3, owner=(None, 3)), version(9, ref1=4, owner=(1, 4)), version(1, ref1=8, owner=(7, 7), db=2), version(5, ref1=6, owner=(1, 1), at=1), version(5, ref1=6, owner=(5, 5), at=0)]
    entries = [(1, 4, 1, 0, 0, 1, 2, 1, 1, 0), (1, 3, 1, 0, 0, 1, 2, 1, 1, 0), (1, 1, 1, 1, 0, 8, 8, 1, 1, 0), (1, 1, 1, 0, 0, 0, 0, 1, 1, 0), (1, 1, 1, 0, 0, 2147483649, 2147483649, 1, 1, 0), (2, 1, 1, 0, 0, 1, 1, 1, 1, 0)]
    v, e = (clashing(spark.createDataFrame(x * 2, s)) for x, s in ((versions, VERSIONS), (entries, ENTRIES)))
    want = [("children", 1, 1, 1, 1, 1, 2, "later"), ("children", 1, 1, 1, 1, 1, 5000, "later"), ("children", 1, 1, 1, 1, 1, 77, "missing"), ("owner", 1, 5, 1, 5000, 1, 2, "deleted"), ("index", 1, 4, 1, 2, 1, 2, "deleted"), ("index", 2, 1, 1, 1, 1, 1, "missing"), ("owner", 2, 1, 1, 8, 7, 7, "missing")]
    assert rows(orphan_references(v, e)) == sorted(want, key=repr)
    none = spark.createDataFrame([], VERSIONS), spark.createDataFrame([], ENTRIES)
    assert orphan_references(*none).count() == 0
    assert {r.miss_kind for r in orphan_references(none[0], e.drop("k")).collect()} == {"missing"}


def test_runs_cover_exactly_the_keys(spark):
    keys = sorted(random.Random(5).sample(range(30000), 9000)) + [1, 2, 2]
    df = spark.createDataFrame([(1, k) for k in keys], "g int, k bigint")
    runs = contiguous_runs(df, ["g"], "k").collect()
    assert sorted(x for r in runs for x in range(r.run_start, r.run_end + 1)) == sorted(set(keys)) and len(runs) < len(set(keys))


# 6


def plainly(parents):
    def up(x):
        path = [x]
        while parents[path[-1]] is not None:
            path.append(parents[path[-1]])
            if len(path) > len(parents) + 1:
                return None
        return path[::-1]

    return {x: up(x) for x in parents}


@pytest.mark.parametrize("shape", ["bush", "line", "star", "loops"])
def test_hierarchy(spark, shape):
    rng = random.Random(shape)
    n = 300 if shape != "line" else 70
    parents = {i: None if i == 0 else {"bush": rng.randrange(i), "line": i - 1, "star": 0, "loops": rng.randrange(n)}[shape] for i in range(n)}
    if shape == "loops":
        parents |= {3: 3, 10: 11, 11: 10, 0: None, 1: None}
    links = spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")
    found = {r.id: r for r in hierarchy(links, paths=True, segment=8 if shape == "line" else 2 if shape == "bush" else 4096).collect()}
    true = plainly(parents)
    assert set(found) == set(parents)
    for x, path in true.items():
        assert (found[x].depth, found[x].root, found[x].path) == ((-1, None, None) if path is None else (len(path) - 1, path[0], path))
    for x in [k for k, p in true.items() if p]:
        below = {y for y, p in true.items() if p and x in p[:-1]}
        inside = {y for y, r in found.items() if r.root == found[x].root and r.depth >= 0 and found[x].preorder < r.preorder <= found[x].last_descendant}
        assert below == inside and found[x].n_descendants == len(below)


def test_subtree_sums(spark):
    rng = random.Random(8)
    parents = {i: None if i % 50 == 0 else rng.randrange(i) for i in range(200)} | {300: 300}
    links = spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")
    true = plainly(parents)
    want = {x: sum(y for y, p in true.items() if p and x in p) for x, path in true.items() if path}
    for bits in (2, 14):
        got = {r.id: r.total for r in subtree_sums(hierarchy(links).withColumn("a", F.col("id")), "a", bits).collect()}
        assert got == want
    assert subtree_sums(hierarchy(links.limit(0)).withColumn("a", F.col("id")), "a").count() == 0


def test_element_parents(spark):
    kids = lambda *r: [(1, x) for x in r]
    versions = [version(1, ref1=1, children=kids(2, 3, 5)), version(1, ref1=2), version(1, ref1=3, owner=(None, None)), version(1, ref1=4, owner=(1, 99)), version(1, ref1=5, owner=(1, 4)), version(1, ref1=6, children=kids(3)), version(1, ref1=7, owner=(1, 7)), version(1, ref1=8, owner=(1, 7)), version(1, ref1=9, owner=(1, 1)), version(2, True, ref1=9), (1, None, 5, 1, 1, "X", 1, 0, 0, None, None, False), (1, (1 << 32) - 1, 5, 1, 1, "X", 1, 1, 1, None, None, False)]
    found = element_hierarchy(clashing(spark.createDataFrame(versions * 2, VERSIONS))).select("ref0", "ref1", "root_ref0", "root_ref1", "depth")
    want = [(1, 1, 1, 1, 0), (1, 2, 1, 1, 1), (1, 3, 1, 3, 0), (1, 4, 1, 4, 0), (1, 5, 1, 4, 1), (1, 6, 1, 6, 0), (1, 7, 0, 0, -1), (1, 8, 0, 0, -1), ((1 << 32) - 1, 5, 1, 1, 1)]
    assert rows(found) == sorted(want, key=repr)
    assert element_hierarchy(spark.createDataFrame([], VERSIONS), paths=True).count() == 0


# Ordered work in blocks


@pytest.mark.parametrize("blocks", [1, 2, 9])
def test_blocks_equal_plain_windows(spark, blocks):
    rng = random.Random(blocks)
    data = [(rng.choice([1, 1, 1, rng.randint(2, 5)]), i, rng.choice([None, rng.randint(0, 9)]), rng.randint(0, 5)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "g int, o bigint, v int, a int")
    cuts = cut_points(df, F.col("o"), blocks)
    blocked = df.withColumn("b", block_of(F.col("o"), cuts))
    assert blocked.select("b").distinct().count() <= blocks
    for inclusive in (True, False):
        want, last = {}, {}
        for g, o, v, _ in sorted(data, key=lambda x: x[1]):
            if inclusive and v is not None:
                last[g] = v
            want[g, o] = last.get(g)
            if v is not None:
                last[g] = v
        got = {(r.g, r.o): r.x for r in carry_forward(blocked, ["g"], "b", ["o"], F.col("v"), "x", inclusive).collect()}
        assert got == want
    numbered = {(r.g, r.o): (r.n, r.s) for r in sums_before(row_numbers(blocked, ["g"], "b", ["o"], "n"), ["g"], "b", ["o"], "a", "s").collect()}
    count, total = {}, {}
    for g, o, _, a in sorted(data, key=lambda x: x[1]):
        assert numbered[g, o] == (count.get(g, 0), total.get(g, 0))
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + a


def test_long_groups_are_cut_evenly(spark):
    rng = random.Random(2)
    # One group in many sessions, one within a single session, one that is short.
    data = [(1, (s << 32) + o) for s in range(-1, 40) for o in range(rng.choice([1, 5, 60]))] + [(2, (7 << 32) + o) for o in rng.sample(range(3000), 900)] + [(3, 5)]
    df = spark.createDataFrame(data, "g int, at bigint")
    cut = cut_groups(df, ["g"], "at", long_groups(df, ["g"], "at", 100), 100).collect()
    assert all(r.is_long == (r.g < 3) for r in cut) and {r.block for r in cut if r.g == 3} == {0}
    for g in (1, 2):
        mine = sorted((r["at"], r.block) for r in cut if r.g == g)
        assert [b for _, b in mine] == sorted(b for _, b in mine)
        sizes = [sum(b == k for _, b in mine) for k in {b for _, b in mine}]
        assert max(sizes) <= 180 and len(sizes) >= len(mine) // 100
    assert long_groups(df, ["g"], "at", 10_000) is None


# Trees by level and by doubling


@pytest.mark.parametrize("several", [False, True])
def test_descend(spark, several):
    from elemlake.operators.tree import _by_level, descend

    rng = random.Random(several)
    pairs = {(rng.randrange(max(1, i)) if several else i - 1, i) for i in range(1, 60) for _ in range(4 if several else 1)} | {(59, 30), (70, 71), (71, 70)}
    edges = spark.createDataFrame([(1, 1, a, 1, b) for a, b in pairs], "dbnum int, parent0 bigint, parent1 bigint, ref0 bigint, ref1 bigint")
    roots = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "dbnum int, ref0 bigint, ref1 bigint")
    want, level, depth = {0: 0}, {0}, 0
    while level:
        depth += 1
        level = {b for a, b in pairs if a in level} - set(want)
        want |= {b: depth for b in level}
    assert {r.ref1: r.depth for r in descend(roots, edges).collect()} == want
    limited = _by_level(roots.distinct().withColumn("depth", F.lit(0)), edges, 2)
    assert {r.ref1: r.depth for r in limited.collect()} == {k: d for k, d in want.items() if d <= 2}
