"""What is kept between runs, archives, the shared folder, and searches of many words."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from elemlake.operators import chunks, persistence
from elemlake.operators.search import insert_ignore, search
from elemlake.plans import workspace
from tests.test_problems import VERSIONS, version

SESSIONS = "dbnum int, sesno int, ses_pgno bigint, prev_ses_pgno bigint, start_pgno bigint, end_pgno bigint, index_root_pgno bigint, claim_pgno bigint, ts timestamp, computer_name string, comments string, add_count int, modify_count int, delete_count int"
STATUS = "dbnum int, ref0 bigint, ref1 bigint, sesno int, operation string"


def session(sesno, **v):
    return (1, sesno, v.get("page"), None, None, None, None, None, None, v.get("computer"), None, 9, 9, 9)


def test_session_statistics_and_records(spark):
    sessions = spark.createDataFrame([session(1, computer='a "b"'), session(1, computer='a "b"'), session(2, page=7), session(None)], SESSIONS)
    status = spark.createDataFrame([(1, 1, 1, 1, "Add"), (1, 1, 2, 1, "Add"), (1, 1, 3, 1, "Deleted"), (1, 1, 1, 9, "Add")], STATUS)
    rows = {r.sesno: (r.add_count, r.modify_count, r.delete_count) for r in persistence.session_statistics(sessions, status).collect()}
    assert rows == {1: (2, 0, 1), 2: (0, 0, 0)}
    records = {r.sesno: r.json for r in persistence.session_json(sessions).collect()}
    assert records[1] == '{"id":"1_1","sesno":1,"pgno":0,"dbnum":1,"index_pgno":0,"claim_pgno":0,"end_pgno":0,"computer_name":"a \\"b\\"","comments":"","date":""}' and '"pgno":7' in records[2]


def test_noun_history_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "history")
    first = [version(1, ref1=1), version(2, ref1=1), version(1, ref1=2, noun="VALV"), version(2, True, ref1=2), version(1, ref1=3)]
    later = [*first, version(3, ref1=1), version(4, ref1=2, noun="VALV")]
    for rows in (first, first, later):
        persistence.save_noun_history(spark.createDataFrame(rows * 2, VERSIONS), path)
    saved = spark.read.parquet(path)
    assert sorted((r.noun, r.ref1, r.sesno) for r in saved.collect()) == [("PIPE", 1, 1), ("PIPE", 1, 2), ("VALV", 2, 1)]
    assert {p.name for p in Path(path).iterdir() if p.is_dir()} == {"noun=PIPE", "noun=VALV"}


def test_subset(spark):
    kids = lambda *refs: [(1, r) for r in refs]
    versions = spark.createDataFrame([version(1, ref1=1, noun="WORL", children=kids(3, 2)), version(1, ref1=2, children=kids(9, 3, 1, 4)), version(1, ref1=3), version(1, ref1=4), version(2, True, ref1=4)], VERSIONS)
    wanted = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 1, 3), (1, 1, 4)], "dbnum int, ref0 bigint, ref1 bigint")
    lists = lambda df: {r.ref1: [c.ref1 for c in r.children] for r in df.collect()}
    assert lists(persistence.subset(versions, wanted)) == {1: [3, 2], 2: [3, 1, 4], 3: []}
    assert lists(persistence.subset(versions, wanted, with_worlds=False)) == {2: [3, 4], 3: []}
    assert persistence.subset(versions, wanted.limit(0), False).count() == 0


def test_nulls_are_values_of_a_key(spark):
    stored = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    new = spark.createDataFrame([(1, None), (1, None), (1, 2), (2, 3), (None, None)], "a int, b int").withColumn("c", F.lit(0))
    assert sorted(map(tuple, insert_ignore(stored, new, ["a", "b"]).collect()), key=repr) == [(1, 2, 0), (None, None, 0)]


def test_archive_and_seeds_rebuild_files(spark):
    rng = random.Random(6)
    base = bytes(rng.randrange(256) for _ in range(60_000))
    changed = base[:20_000] + b"inserted" + base[20_000:]
    files = spark.createDataFrame([("old", bytearray(base)), ("new", bytearray(changed)), ("twice", bytearray(base + base)), ("empty", bytearray())], "path string, content binary")
    table = chunks.chunk_table(files)
    seeds = chunks.chunk_contents(files.where("path = 'old'"))
    missing = chunks.missing_chunks(table, seeds)
    fetched = chunks.chunk_contents(files).join(missing, "hash", "left_semi")
    assert fetched.agg(F.sum(F.length("content"))).first()[0] < 30_000  # what lies around the insertion and the seam
    whole = {r.path: r for r in chunks.rebuild(table, seeds.unionByName(fetched)).collect()}
    assert {p: hashlib.md5(r.content).digest() for p, r in whole.items()} == {"old": hashlib.md5(base).digest(), "new": hashlib.md5(changed).digest(), "twice": hashlib.md5(base * 2).digest()}
    lost = {r.path: r for r in chunks.rebuild(table, seeds).collect()}
    assert lost["old"].missing == 0 and lost["new"].missing > 0 and lost["new"].content is None


def test_searches_of_many_words(spark):
    docs = spark.createDataFrame([(str(i), f"1_{i}", " ".join(f"w{j:03d}" for j in range(i)), "PIPE", 1, "") for i in (99, 100, 130)], "id string, refno string, name string, element_type string, sesno int, attributes_text string")
    found = search(docs, " ".join(f"w{j:03d}" for j in range(100)))
    assert sorted(r.id for r in found.collect()) == ["100", "130"]


def test_tables_of_the_shared_folder(spark, monkeypatch):
    with workspace.tables():
        kept = workspace.written(spark.range(5).toDF("id"), "some")
        by_id = workspace.bucketed(kept, "others", ["id"], buckets=2)
        assert by_id.count() == 5
        paths = [Path(x._elemlake_path.removeprefix("file:")) for x in (kept, by_id)]
        assert all(p.exists() for p in paths)
    assert not any(p.exists() for p in paths)
    counted, n = workspace.written_counting(spark.range(5).toDF("id"), "counted", F.col("id") > 2)
    assert n == 2 and counted.count() == 5

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        workspace.shared_dir(Cluster())
