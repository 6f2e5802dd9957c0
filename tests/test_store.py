"""Codecs: what is written is read again; index and record rules on small stores of our own."""

from __future__ import annotations

import struct
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from elemlake.codec.store import ENTRIES_AT, START_MARKER, Element, Place, ShortError, StoreError, Writer, decode_text, encode_text, read_element, read_entries, scan_records, session_time, store_of_bytes, write_element
from elemlake.functions.names import python_name_hash, python_name_of_hash
from elemlake.sources.dblist import parse_dump, write_dump
from elemlake.sources.dictionary import Dictionary, Record, decode_dictionary, encode_dictionary, noun_schema, read_dictionary

word32 = st.integers(1, (1 << 32) - 1)
names = st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=1, max_size=6)
values = st.one_of(
    st.tuples(st.just("int"), st.integers(-(1 << 31), (1 << 31) - 1)), st.tuples(st.just("bool"), st.booleans()), st.tuples(st.just("double"), st.floats(allow_nan=False)),
    st.tuples(st.just("doubles"), st.lists(st.floats(allow_nan=False), max_size=4)), st.tuples(st.just("ints"), st.lists(st.integers(0, 9), max_size=4)),
    st.tuples(st.just("refs"), st.lists(st.tuples(word32, word32), max_size=3)), st.tuples(st.just("element"), st.tuples(word32, word32)),
    st.tuples(st.just("string"), st.text("abc 综合技术é'/", max_size=40).map(lambda t: t.rstrip("\0"))),
)


@settings(max_examples=200, deadline=None)
@given(st.tuples(word32, word32), names, st.tuples(word32, word32), st.lists(st.tuples(word32, word32), max_size=6), st.dictionaries(names, values, max_size=5))
def test_record_round_trip(refno, noun, owner, children, attrs):
    element = Element(refno, noun, owner, children, attrs)
    read = read_element(write_element(element) + b"\1\2\3\4")
    assert (read.refno, read.noun, read.owner, read.children, read.attrs) == (refno, noun, owner, children, attrs)


PLACES = [Place("NUM", 6, 0, "Integer"), Place("MASS", 7, 0, "Real"), Place("LOCK", 9, 0, "Boolean"), Place("BUIL", 9, 3, "Boolean"), Place("POS", 10, 0, "Position"), Place("SPRE", 16, 0, "Reference"), Place("PURP", 18, 0, "Enum"), Place("RULE", 19, 0, "Real", True), Place("DESC", 20, 0, "Text")]


@settings(max_examples=150, deadline=None)
@given(
    st.tuples(word32, word32), st.lists(st.tuples(word32, word32), max_size=9), st.dictionaries(names.filter(lambda n: n not in {p.attr for p in PLACES}), values, max_size=4), st.integers(12, 40), st.booleans(),
    st.fixed_dictionaries({"NUM": st.integers(-9, 1 << 30), "MASS": st.sampled_from([0.0, 2.5, -1024.25]), "LOCK": st.booleans(), "BUIL": st.booleans(), "POS": st.lists(st.sampled_from([0.0, 1.5, -3.25]), min_size=3, max_size=3), "SPRE": st.tuples(word32, word32), "PURP": names, "DESC": st.sampled_from(["", "pump", "综合 a"])}),
)
def test_segments_and_fixed_parts(refno, children, attrs, most_words, short, fixed):
    kinds = {"NUM": "int", "MASS": "double", "LOCK": "bool", "BUIL": "bool", "POS": "doubles", "SPRE": "element", "PURP": "string", "DESC": "string"}
    layouts = {"PUMP": PLACES}
    whole = {k: (kinds[k], v) for k, v in fixed.items()} | attrs
    data = write_element(Element(refno, "PUMP", (1, 2), children, whole), layouts, most_words, short)
    read = read_element(b"\0\0\0\7" + data + b"\1\2\3\4", layouts)
    assert read.children == children and read.attrs == whole
    assert set(read_element(data).attrs) == set(attrs)  # without a layout, what the blocks say
    for end in range(0, len(data) - 1, 7):
        with pytest.raises(ShortError):
            read_element(data[:end], layouts)


def test_other_ends_and_paddings():
    data = write_element(Element((1, 2), "PUMP", (1, 2), [(3, 4)], {"NUM": ("int", 5)}))
    fixed, rest = data[:24], data[24:-8]
    for padded in (fixed + b"\0" * 8 + b"\0\0\0\7" + rest + b"\0\0\0\7\0\0\0\6", fixed + rest + b"\0" * 12 + b"\0\0\0\7"):
        read = read_element(padded)
        assert (read.children, read.attrs) == ([(3, 4)], {"NUM": ("int", 5)})
    with pytest.raises(StoreError, match="padding"):
        read_element(fixed + b"\0" * 9000)


@given(st.text("aZ 0综合技术廊道厂房()é", max_size=30))
def test_text_round_trip(text):
    assert decode_text(encode_text(text)) == text


@pytest.mark.parametrize(("raw", "text"), [("267E575B3A4F3C3C4A754048354020 26".replace(" ", ""), "综合技术廊道"), ("", ""), ("6162", "ab")])
def test_bracketed_text(raw, text):
    assert decode_text(bytes.fromhex(raw)) == text


@given(names)
def test_name_hash(name):
    assert python_name_of_hash(python_name_hash(name)) == name


def store_of_three_sessions():
    w = Writer(7001)
    w.commit(1, [Element((5, i), "SITE", (5, 1), [], {"NAME": ("string", f"/S{i}")}) for i in range(1, 400)], ts=datetime(2015, 3, 4, 5, 6, 7), computer="desk", comment="first")
    w.commit(2, [Element((5, 17), "ZONE", (5, 1), [(5, 18)], {"MASS": ("double", 2.5)})], removed=((5, 20),), ts=datetime(2015, 3, 5))
    w.commit(3, [Element((6, 1), "PIPE", (5, 17), [], {"DESC": ("string", "x" * 9000)})])
    return w.bytes()


def test_store_sessions_and_lookup():
    store = store_of_bytes(store_of_three_sessions())
    sessions = store.sessions()
    assert [s.sesno for s in sessions] == [1, 2, 3] and sessions[0].ts == datetime(2015, 3, 4, 5, 6, 7) and sessions[0].computer_name == "desk" and sessions[0].comments == "first"
    assert [s.first_pgno for s in sessions[1:]] == [s.end_pgno + 1 for s in sessions[:-1]] and all(not s.violations() for s in sessions)
    first, second, third = (s.index_root_pgno for s in sessions)
    assert len(store.newest(first)) == 399 and len(store.newest(third)) == 399
    assert store.find(first, (5, 20)) and store.find(second, (5, 20)) is None and store.find(first, (9, 9)) is None and store.find(third, (5, 1))
    assert store.record(store.address(store.find(first, (5, 17)))).noun == "SITE"
    assert store.record(store.address(store.find(third, (5, 17)))).children == [(5, 18)]
    assert len(store.record(store.address(store.find(third, (6, 1)))).attrs["DESC"][1]) == 9000  # over several pages
    for key in store.newest(third):
        assert store.address(store.find(third, key)) == store.address(store.newest(third)[key])


def test_scan_finds_what_the_index_finds():
    data = store_of_three_sessions()
    store = store_of_bytes(data)
    scanned = {}
    for at, e in scan_records(data, {5, 6}, 0, len(data)):
        scanned[e.refno] = max(at, scanned.get(e.refno, 0))
    indexed = {k: store.address(e) for k, e in store.newest(store.sessions()[-1].index_root_pgno).items()}
    assert {k: scanned[k] for k in indexed} == indexed and set(scanned) - set(indexed) == {(5, 20)}


@pytest.mark.parametrize("size", [512, 2048, 4096])
def test_page_size_is_probed(size):
    w = Writer(1, size)
    w.commit(1, [Element((1, 1), "SITE", (0, 0))])
    data = bytearray(w.bytes())
    struct.pack_into(">I", data, 0x34, 512)  # the header lies
    assert store_of_bytes(bytes(data)).page_size == size


def test_entries_end_at_zero_and_later_record_wins():
    page = bytearray(2048)
    struct.pack_into(">3I", page, 0, 1, 0xCC47DF, 0)
    struct.pack_into(">I", page, 12, 1)  # declares one entry
    for i, row in enumerate([(3, 4, 7, 5 << 12), (3, 4, 9, 5 << 12), (3, 5, 9, 6 << 12)]):
        struct.pack_into(">4I", page, ENTRIES_AT + 16 * i, *row)
    rows = read_entries(bytes(page), 2)
    assert len(rows) == 3 and rows[0].offset_words == 5
    with pytest.raises(StoreError):
        read_entries(bytes(2048), 1)
    assert START_MARKER == 2147483649


def test_impossible_dates_are_none():
    assert session_time(2020, 13, 30, 0) is None and session_time(2020, 2, 24 * 29 + 3, 125) == datetime(2020, 2, 29, 3, 2, 5)


def test_dump_rules():
    text = "﻿-- note\nstray\nINPUT BEGIN\nlost 1\nEND\nNEW BRANCH /A b\nDESC  'two   words' $\n   and more\nLEAVE\nEND\nNEW VALV\nANGL 3mm\nINPUT FINISH\nNEW X\n"
    dump = parse_dump(text)
    assert dump.elements == [("BRANCH", "/A b", [["DESC", "'two words' and more"], ["LEAVE", ""]]), ("VALV", None, [["ANGL", "3mm"]])]
    assert len(dump.warnings) == 1 and parse_dump("").elements == []
    assert parse_dump(write_dump(dump.elements)).elements == dump.elements


def test_dictionary_round_trip(spark, tmp_path):
    many = [f"{a}{b}" for a in "ABCDEFGHIJ" for b in "KLMNOPQRSTUVWXYZ"]
    found = Dictionary(
        [Record(7, "MASS", 6, ["the mass", "m", "Mass", "physics"]), Record(8, "DESC", 99, []), Record(9, "SPRE", 1, ["a reference"]), *(Record(10 + i, n, 2, ["x" * 40]) for i, n in enumerate(many))],
        [(python_name_hash("PIPE"), 1, 5), *((python_name_hash("BRAN"), i % 160 + 1, 1) for i in range(400))],
        [(python_name_hash("MASS"), 2, 1, 0), (python_name_hash("DESC"), 5, 2, 1), (python_name_hash("SPRE"), 4, 2, 2), *((python_name_hash(n), 1, 4, 0) for n in many * 2)],
        [42, 2, 100, 200],
        [(python_name_hash(n), 3, i) for i, n in enumerate(many * 3)],
        [(5, 1, 2), (9, 0, 7)],
    )
    data = encode_dictionary(found)
    read = decode_dictionary(data)
    assert read.records[0] == found.records[0] and read.records[1].unit == -1 and read.records[2:] == found.records[2:]
    assert (read.nouns, read.definitions, read.defaults, read.index, read.syntax) == (found.nouns, found.definitions, found.defaults, found.index, found.syntax)
    assert decode_dictionary(b"") == Dictionary() and len(decode_dictionary(data[: len(data) // 2]).records) > 0
    (tmp_path / "d.dat").write_bytes(data)
    attributes, nouns = read_dictionary(spark, str(tmp_path / "d.dat"))
    rows = {r.name: r for r in attributes.collect()}
    assert (rows["MASS"].data_type, rows["MASS"].storage, rows["MASS"].unit_name, rows["MASS"].category) == ("Real", "DAB", "Mass", "physics")
    assert (rows["DESC"].data_type, rows["DESC"].unit_name) == ("Text", "Invalid") and rows[many[0]].storage == "Pseudo"
    schema = noun_schema(attributes, nouns)
    assert {(r.noun, r.attr, r.data_type) for r in schema.where("noun = 'PIPE'").collect()} == {("PIPE", "DESC", "Text")} and schema.count() == 401
    assert noun_schema(attributes, nouns, 1).where("noun = 'PIPE'").first().attr == "MASS"


def test_data_source(spark, tmp_path):
    from elemlake.sources.store import StoreSource, load_offsets, save_offsets

    (tmp_path / "a.db").write_bytes(store_of_three_sessions())
    (tmp_path / "acom").write_bytes(b"no store")
    spark.dataSource.register(StoreSource)
    read = lambda t, **o: spark.read.format("elemlake_store").option("table", t).options(**o).load(f"{tmp_path}/*")
    assert [r.sesno for r in read("sessions").orderBy("sesno").collect()] == [1, 2, 3]
    assert read("headers").first().page_size == 2048
    assert read("elements").count() == 401 and read("elements", min_sesno="2", max_sesno="2").count() == 1
    assert read("attributes").where("key = 'MASS'").first().v_double == 2.5
    assert read("index").where("level = 0").count() > 401
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [tuple(r) for r in read("elements", push="true").where("sesno >= 2 and sesno < 3").select("ref1", "noun", "error").collect()] == [(17, "ZONE", None)]
    assert read("elements", push="true").where("sesno > 3").count() == 0 and read("elements", push="true").where("sesno <= 2 and ref1 = 17").count() == 2
    from elemlake.operators.lookup import index_map

    save_offsets(index_map(read("index")), str(tmp_path / "saved"), 2048)
    assert load_offsets(spark, str(tmp_path / "saved"), 2048).count() == 400
    with pytest.raises(ValueError):
        load_offsets(spark, str(tmp_path / "saved"), 4096)


def test_damaged_index_is_scanned(spark, tmp_path):
    from elemlake.sources.store import StoreSource, read_store

    data = bytearray(store_of_three_sessions())
    (tmp_path / "whole.db").write_bytes(data)
    spark.dataSource.register(StoreSource)
    tables = {t: sorted(map(repr, read_store(spark, f"{tmp_path}/whole.db", t).collect())) for t in ("elements", "attributes")}
    assert len(tables["elements"]) == 401
    for s in store_of_bytes(bytes(data)).sessions():  # every root
        data[s.index_root_pgno * 2048 : s.index_root_pgno * 2048 + 2048] = bytes(2048)
    (tmp_path / "broken.db").write_bytes(data)
    with pytest.raises(Exception, match="StoreError"):
        spark.read.format("elemlake_store").option("table", "elements").load(f"{tmp_path}/broken.db").count()
    for t, want in tables.items():
        for size in ("3001", "16777216"):  # records over the ends of segments
            assert sorted(map(repr, read_store(spark, f"{tmp_path}/broken.db", t, segment_bytes=size).collect())) == want
    assert sorted(map(repr, read_store(spark, f"{tmp_path}/*.db").collect())) == sorted(tables["elements"] * 2)


def test_unreadable_records_are_told(spark, tmp_path):
    from elemlake.sources.store import StoreSource, layout_option

    data = bytearray(store_of_three_sessions())
    store = store_of_bytes(bytes(data))
    struct.pack_into(">I", data, store.address(store.newest(store.sessions()[0].index_root_pgno)[5, 33]), 3)  # a record of three words
    (tmp_path / "a.db").write_bytes(data)
    spark.dataSource.register(StoreSource)
    read = lambda t, **o: spark.read.format("elemlake_store").option("table", t).options(**o).load(f"{tmp_path}/a.db")
    for t in ("elements", "attributes"):
        lost = read(t).where("error is not null").collect()
        assert [(r.ref0, r.ref1, r.sesno) for r in lost] == [(5, 33, 1)] and "shorter" in lost[0].error
        with pytest.raises(Exception, match="shorter"):
            read(t, errors="fail").count()
    assert read("elements").count() == 401
    w = Writer(1)
    w.layouts = {"PUMP": PLACES}
    w.commit(1, [Element((1, 1), "PUMP", (0, 0), [], {"MASS": ("double", 2.5), "LOCK": ("bool", True), "EXTRA": ("int", 4)})])
    (tmp_path / "b.db").write_bytes(w.bytes())
    layout = spark.createDataFrame([("PUMP", p.attr, 1, p.word, p.bit, p.kind, None, p.is_expr) for p in PLACES], "noun string, attr string, attr_hash bigint, word_offset int, bit_index int, attr_type string, default_tag string, is_expr boolean")
    found = spark.read.format("elemlake_store").option("table", "attributes").option("layout", layout_option(layout)).load(f"{tmp_path}/b.db")
    got = {r.key: r for r in found.collect()}
    assert got["MASS"].v_double == 2.5 and got["LOCK"].v_bool is True and got["BUIL"].v_bool is False and got["EXTRA"].v_int == 4 and set(got) == {p.attr for p in PLACES if not p.is_expr} | {"EXTRA"}


def test_unreadable_session_pages(spark, tmp_path):
    from elemlake.sources.store import StoreSource, read_store

    spark.dataSource.register(StoreSource)
    sessions = store_of_bytes(store_of_three_sessions()).sessions()
    for lost, known in ((0, {(3, 1), (None, 399)}), (2, {(None, 400)})):  # what lies before the next session left, or all
        data = bytearray(store_of_three_sessions())
        data[sessions[lost].ses_pgno * 2048 : sessions[lost].ses_pgno * 2048 + 2048] = bytes(2048)
        (tmp_path / f"{lost}.db").write_bytes(data)
        found = read_store(spark, f"{tmp_path}/{lost}.db")
        assert {tuple(r) for r in found.groupBy("sesno").count().collect()} == known
        assert found.where("ref1 = 17").first().noun == "ZONE"  # the larger address
    with pytest.raises(Exception, match="no session page"):
        spark.read.format("elemlake_store").option("table", "elements").load(f"{tmp_path}/2.db").count()


def test_read_dumps(spark, tmp_path):
    from elemlake.sources.dblist import read_cases, read_dumps

    (tmp_path / "one.txt").write_text("INPUT BEGIN\nNEW PIPE /P\nBORE 3\nEND\nINPUT END\n")
    rows = read_dumps(spark, str(tmp_path / "one.txt")).collect()
    assert [tuple(r) for r in rows] == [("one.txt", 1, "PIPE", "/P", 1, "BORE", "3")]
    (tmp_path / "cases.json").write_text('{"description": "d", "cases": [{"name": "n", "refno": "1/2", "file_path": "f", "attr": "PX", "expected": "1"}]}')
    assert read_cases(spark, str(tmp_path / "cases.json")).first().enabled is True
