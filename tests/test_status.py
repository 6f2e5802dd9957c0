"""Status by the owners' present child lists, on hand-made versions."""

from __future__ import annotations

from elemlake.operators.changes import change_counts, content_hashes, increments, operation_status, primary_status
from tests.test_problems import ATTRS, VERSIONS, version


def test_status_by_owner(spark):
    kids = lambda *refs: [(1, r) for r in refs]
    data = [
        version(1, ref1=1, children=kids(10, 11, 12, 13)), version(4, ref1=1, children=kids(10, 13, 14, 16)),  # an owner that dropped 11 and 12
        version(1, ref1=2, children=kids(20)), version(4, ref1=2, children=None),  # an owner that is left empty
        version(2, ref1=10, owner=(1, 1)), version(3, ref1=10, owner=(1, 1)),  # still listed
        version(2, ref1=11, owner=(1, 1)), version(3, ref1=11, owner=(1, 1)),  # dropped without a removal
        version(2, ref1=12, owner=(1, 1)),  # dropped, but one version only
        version(2, ref1=13, owner=(1, 1)), version(3, True, ref1=13, owner=(1, 1)),  # removed
        version(2, ref1=14, owner=(1, 2)), version(5, ref1=14, owner=(1, 1)),  # moved from an owner that is empty now
        version(1, ref1=3, children=kids(30)), version(2, ref1=16, owner=(1, 3)), version(5, ref1=16, owner=(1, 1)),  # moved from one that lists what the new one does not
        version(2, ref1=17, owner=(9, 9)), version(5, ref1=17, owner=(9, 9)), version(2, ref1=18, owner=(9, 9), noun="SITE"), version(5, ref1=18, owner=(9, 9), noun="SITE"),  # no such owner
        version(2, True, ref1=19), version(5, ref1=19),  # nothing before it but a removal
    ]
    got = {r.ref1: r.operation for r in primary_status(spark.createDataFrame(data, VERSIONS)).collect()}
    assert got == {1: "Modified", 2: "Modified", 3: "Add", 10: "Modified", 11: "Deleted", 12: "Add", 13: "Deleted", 14: "Modified", 16: "Deleted", 17: "Deleted", 18: "Modified", 19: "Add"}


def a(ref1, ses, value):
    return (1, 1, ref1, ses, "att", "FOO", "t", value, *[None] * 7)


def history():
    kids = lambda *refs: [(1, r) for r in refs]
    versions = [
        version(1, ref1=1, children=kids(10, 11, 12, 13)), version(3, ref1=1, children=kids(10, 13)), version(5, ref1=1, children=kids(10, 13)), version(7, ref1=1, children=kids(13)),
        version(1, ref1=10, owner=(1, 1)), version(2, ref1=10, owner=(1, 1)), version(4, ref1=10, owner=(1, 1)),  # an attribute, then nothing
        version(1, ref1=11, owner=(1, 1)), version(2, ref1=11, owner=(1, 1)), version(3, ref1=11, owner=(1, 1)),  # dropped in 3, with a version of its own there
        version(1, ref1=12, owner=(1, 1)),  # dropped in 3
        version(1, ref1=13, owner=(1, 1)), version(6, True, ref1=13, owner=(1, 1)), version(8, ref1=13, owner=(1, 1)),
        version(2, ref1=5, owner=(9, 9), noun="SITE", children=kids(77)), version(3, ref1=5, owner=(9, 9), noun="SITE"), version(2, ref1=6, owner=(9, 9)), version(3, ref1=6, owner=(9, 9)),
    ]
    attrs = [a(10, 1, 1), a(10, 2, 2), a(10, 4, 2), a(11, 1, 1), a(11, 2, 1), a(11, 3, 2), a(12, 1, 1)]
    return versions, attrs


def test_rules_of_the_status(spark):
    versions, attrs = history()
    v, t = spark.createDataFrame(versions * 2, VERSIONS), spark.createDataFrame(attrs * 2, ATTRS)
    status = lambda df: sorted((r.ref1, r.sesno, r.operation) for r in df.collect())
    common = [(1, 1, "Add"), (1, 3, "Modified"), (1, 7, "Modified"), (5, 2, "Add"), (5, 3, "Modified"), (6, 2, "Add"), (6, 3, "Deleted"), (10, 1, "Add"), (11, 1, "Add"), (11, 3, "Deleted"), (12, 1, "Add"), (12, 3, "Deleted"), (13, 1, "Add"), (13, 6, "Deleted"), (13, 8, "Add"), (77, 3, "Deleted"), (10, 7, "Deleted")]
    # 1 has no list that holds 10 and 11 now, but it had when 2 and 4 were written.
    now = [*common, (10, 2, "Deleted"), (10, 4, "Deleted"), (11, 2, "Deleted")]
    then = [*common, (10, 2, "Modified")]
    assert status(operation_status(v, t)) == sorted(now) and status(operation_status(v, t, "session")) == sorted(then)
    for low, high in ((3, 4), (1, 1), (6, 9), (20, 30)):
        for owner in ("latest", "session"):
            part = increments(v, t, first=low, last=high, owner_as_of=owner)
            whole = operation_status(v, t, owner).where(f"sesno between {low} and {high}")
            assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.select(*part.columns).collect()))
    chosen = spark.createDataFrame([(1, 3), (1, 7), (1, 7), (2, 3)], "dbnum int, sesno int")
    assert status(increments(v, t, chosen)) == [x for x in sorted(now) if x[1] in (3, 7)]
    # Only what newest versions say: 1 is written again in 7, so what it dropped in 3 is not told.
    assert status(increments(v, t, first=3, last=3, only_latest=True)) == [(5, 3, "Modified"), (6, 3, "Deleted"), (11, 3, "Deleted"), (77, 3, "Deleted")]
    empty = spark.createDataFrame([], VERSIONS), spark.createDataFrame([], ATTRS)
    assert operation_status(*empty).count() == 0 and increments(*empty, first=1).count() == 0


def test_hash_and_counts_of_changes(spark):
    both = lambda x, y: ([version(1, **x), version(2, **y)])
    attr = lambda ses, kind, key, **v: (1, 1, 1, ses, kind, key, "t", *({c: None for c in ("v_int", "v_double", "v_bool", "v_str", "v_ints", "v_doubles", "v_strs", "v_refs")} | v).values())
    hashes = lambda versions, attrs, **o: len({r.content for r in content_hashes(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(attrs, ATTRS), **o).collect()})
    volatile = [attr(1, "att", "PGNO", v_int=100), attr(2, "att", "PGNO", v_int=101), attr(1, "att", "SESNO", v_int=200), attr(2, "att", "SESNO", v_int=201)]
    foo = [attr(1, "att", "FOO", v_int=1), attr(2, "att", "FOO", v_int=2)]
    assert hashes(both({}, {}), volatile) == 1 and hashes(both({}, {}), foo) == 2 and hashes(both({}, {}), foo, ignore=("FOO",)) == 1
    assert hashes(both({"children": [(1, 1)]}, {"children": [(1, 1), (1, 2)]}), []) == 2
    versions = both({"children": [(1, 5)]}, {"children": [(1, 5), (1, 6)]})
    versions = [x if x[3] == 1 else (*x[:9], "B", *x[10:]) for x in versions]
    attrs = [*volatile[:2], *foo, attr(1, "exp", "E1", v_str="x"), attr(2, "exp", "E1", v_str="y"), attr(1, "uda", ":123:U", v_int=1), attr(2, "uda", ":123:U", v_int=2)]
    counts = change_counts(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(attrs, ATTRS))
    assert sorted(map(tuple, counts.collect())) == [(k, 1) for k in sorted(["meta:name", "meta:children", "att:PGNO", "att:FOO", "exp:E1", "uda:123:U"])]
