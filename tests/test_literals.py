from __future__ import annotations

from pyspark.sql import functions as F

from elemlake.functions.literals import axis, better_text, bucket_id, byte_address, direction, entry_flag, expression_score, tenths
from elemlake.functions.names import name_hash, name_of_hash, one_space, parse_refno, uda_label, unquoted
from elemlake.operators.lookup import database_names, resolve_versions
from elemlake.streaming.feed import changed_stores


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_literals(spark):
    lit = F.lit
    assert values(spark, direction(lit(12)), direction(lit(9)), tenths(lit(-45)), axis(lit(3), lit(2)), axis(lit(1), lit(0)), axis(lit(7), lit(2))) == ["-X", None, 4.5, "-Z", "X", None]
    assert values(spark, bucket_id(lit(0x9C18E)), entry_flag(lit(0x5001)), byte_address(lit(3), lit(0x5001), 2048)) == [(0x9C18E >> 13) & 0x1FFF, 1, 3 * 2048 + 10]
    assert values(spark, expression_score(lit("PARA[1 ] / 2")), expression_score(lit("12.5")), expression_score(lit("DESP[1 ]"))) == [13, -5, 8]
    assert values(spark, better_text(lit("3"), lit("a + b")), better_text(lit("a"), lit(" ")), better_text(lit("x"), lit("y")), better_text(lit("x"), lit("y"), False)) == ["a + b", "a", "y", "x"]


def test_names(spark):
    lit = F.lit
    assert values(spark, name_hash(lit("NAME")), name_hash(lit(":INSUL")), name_hash(lit("a b")), name_of_hash(lit(639374)), name_of_hash(lit(5))) == [639374, 7336314, None, "NAME", None]
    assert values(spark, uda_label(lit(":INSUL")), uda_label(lit(":123")), one_space(lit("  a \t b ")), unquoted(lit("'it''s'")), unquoted(lit("'"))) == ["UDA_INSUL", "UDA_HASH_123", "a b", "it's", "'"]
    assert [r and tuple(r) for r in values(spark, parse_refno(lit(" =12/34")), parse_refno(lit("1_2")), parse_refno(lit("=1/")))] == [(12, 34), (1, 2), None]


def test_database_names(spark):
    files = spark.createDataFrame([("/d/a1_001.db", 1, 7), ("/d/b", 2, 8), ("/d/c.x", None, None)], "path string, dbnum int, field_no int")
    numbers, fields = spark.createDataFrame([(1, "ONE"), (1, "ONE")], "dbnum int, name string"), spark.createDataFrame([(8, "EIGHT")], "field_no int, name string")
    assert sorted(r.name for r in database_names(files, numbers, fields).collect()) == ["EIGHT", "ONE", "c"]


def test_resolution(spark):
    versions = spark.createDataFrame([(1, 1, 1, s, 0, "P", 0, 0, None, None, False) for s in (2, 5, 9)], "dbnum int, ref0 bigint, ref1 bigint, sesno int, byte_offset bigint, noun string, owner_ref0 bigint, owner_ref1 bigint, name string, children array<struct<ref0:bigint,ref1:bigint>>, deleted boolean")
    sessions = spark.sql("select * from values (1, 2, timestamp'2020-01-02'), (1, 5, timestamp'2020-01-05'), (1, 9, timestamp'2020-01-09'), (2, 1, timestamp'2020-01-06') t(dbnum, sesno, ts)")
    asked = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 1, 1, 7, None), (1, 1, 1, None, None), (1, 1, 1, 1, None), (1, 1, 2, None, None)], "dbnum int, ref0 bigint, ref1 bigint, s int, s_db int")
    got = {(r.ref1, r.s, r.s_db): (r.sesno, r.is_latest) for r in resolve_versions(asked, versions, sessions).collect()}
    assert got == {(1, 1, 2): (5, False), (1, 7, None): (5, False), (1, None, None): (9, True), (1, 1, None): (None, False), (2, None, None): (None, False)}


def test_unchanged_stores_are_passed_over(spark):
    headers = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "path string, latest_ses_pgno bigint")
    known = spark.createDataFrame([("a", 5), ("b", 2)], "path string, latest_ses_pgno bigint")
    assert sorted(r.path for r in changed_stores(headers, known).collect()) == ["b", "c"]


def test_append_sink_can_run_a_batch_again(spark, tmp_path):
    from elemlake.streaming.feed import append_new

    sink = append_new(str(tmp_path / "t"), ["k"])
    batches = [spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")]
    for number in (0, 1, 1, 0):
        sink(batches[number], number)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
