from __future__ import annotations

import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from elemlake.functions.expressions import FUNCTIONS, INFIX, ExpressionError, Options, compile_expression, encode_words, opcode_counts, opcode_histogram, other_elements, stored_number, to_text, tree_of_payload, values_of_others
from elemlake.functions.names import python_name_hash


def n(x):
    return [0x65, 2, x]


def attr(name, low=0, high=0, suffix=0):
    return [0x6A, 0, python_name_hash(name), low, high, suffix]


def text(s):
    return [0x66, len(s), *map(ord, s)]


@pytest.mark.parametrize(
    ("words", "infix", "template"),
    [
        ([*n(1), *n(2), 602], "1 GT 2", "(1 GT 2)"),
        ([*n(1), *n(2), 802, *n(3), 804], "(1 + 2) * 3", "((1+2)*3)"),
        ([*n(1), *n(2), *n(3), 803, 803], "1 - (2 - 3)", "(1-(2-3))"),
        ([*n(1), *n(2), 803, *n(3), 803], "1 - 2 - 3", "((1-2)-3)"),
        ([*n(8), *n(2), *n(45), 902, 804, 805], "8 / (2 * COS ( 45 ))", "(8/(2*COS(45)))"),
        ([*text("it's")], "'it''s'", "'it''s'"),
        ([0x67, 201, 301], "NOT true", "(NOT true)"),
        ([*n(1), *attr("DESP", -1)], "ATTRIB DESP[1 ]", "DESP[1 ]"),
        ([*attr("PARA", 1, 1)], "ATTRIB PARA[1 ]", "PARA[1 ]"),
        ([*attr("NAMN", 1, 500)], "ATTRIB NAMN", "NAMN"),
        ([*attr("NAMN", 2, 5)], "ATTRIB NAMN 2 TO 5", "NAMN 2 TO 5"),
        ([*n(5), 801], "- 5", "(-5)"),
        ([0x6F], "PI", "PI"),
        ([1201], "VAR1", "VAR1"),
        ([*n(1), *n(2), *n(3), 1822], "IFTRUE ( 1 , 2 , 3 )", "IFTRUE(1,2,3)"),
    ],
)
def test_texts(words, infix, template):
    tree = tree_of_payload(encode_words(words))
    assert to_text(tree) == infix and to_text(tree, "template") == template


def test_header_word_and_start():
    words = [1, 0x76, 1, 0x41]
    payload = struct.pack(">6i", 5, 5, *words[:3], words[3])
    assert to_text(tree_of_payload(payload)) == "'A'"


@pytest.mark.parametrize("words", [[9999], [0x67, 201, 701], [*n(1), 802], [*n(1), *n(2)], [0x65, 9, 1], []])
def test_broken_payloads(words):
    with pytest.raises(ExpressionError):
        tree_of_payload(encode_words(words))


def test_unknown_opcodes_are_reported():
    assert opcode_counts(encode_words([9999]))[1] == [9999]
    assert opcode_counts(encode_words([0x67, 201, 701])) == ({0x67: 1, 701: 1}, [701])


@given(st.floats(min_value=-1e6, max_value=1e6).map(lambda x: struct.unpack(">f", struct.pack(">f", x))[0]).filter(lambda x: 2 < abs(x)))
def test_numbers_of_double_parts(x):
    high, low = struct.unpack(">II", struct.pack(">d", x))
    a = (high & 0x1FFFFF) | (0x40000000 if high >> 31 else 0)
    c = 0x40000000 | (high >> 20) & 0x7FF
    assert stored_number(a, low, c) == x


@pytest.mark.parametrize(
    ("words", "expected"),
    [
        ([*attr("A"), *n(2), 805], 1.5), ([*attr("A"), *n(0), 805], None), ([*n(30), 901], 0.5), ([*n(1), 906], 45.0), ([*attr("A"), *n(2), 1002], 9.0),
        ([*n(7), *n(2), 805, 1005], 3), ([*n(7), *n(2), 805, 1006], 4), ([*text("abcabc"), *text("ca"), 1303], 3), ([*text("abcabc"), *text("ca"), 1304], "bc"),
        ([*text("abcabc"), *text("ca"), 1305], "ab"), ([*text("aXbX"), *text("X"), 1321], 2), ([*text("aXbX"), *text("X"), *text("-"), 1322], "a-b-"),
        ([*text("abc"), *text("a*"), 1315], True), ([*text("a b c"), *n(2), 1317], "b"), ([*text("abcd"), *n(2), *n(2), 1309], "bc"), ([*attr("S"), 1307], "TEXT"),
        ([*attr("U"), 1312], True), ([*attr("U"), *text("d"), 1369], "d"), ([*attr("A"), *n(3), 401, *text("y"), *text("n"), 1822], "y"), ([*attr("V"), *n(2), 1101], 20.0),
        ([*attr("S"), 1301], 4), ([*text("12.5"), 1302], 12.5), ([*attr("A"), *n(5), 1008], 5.0), ([*n(2), *attr("V", -1)], 20.0), ([*attr("S", 2, 3)], "ex"), ([*attr("A"), 1828 - 2, 301], True),
    ],
)
def test_compiled(spark, words, expected):
    row = spark.createDataFrame([(3.0, "text", None, [10.0, 20.0])], "A double, S string, U string, V array<double>")
    got = row.select(compile_expression(tree_of_payload(encode_words(words)), F.col).alias("x")).first().x
    assert got == expected if not isinstance(expected, float) else math.isclose(got, expected)


def test_every_function_compiles_or_says_no(spark):
    row = spark.createDataFrame([(1.0,)], "A double")
    for opcode, (_, arity) in FUNCTIONS.items():
        words = [*(attr("A") * arity), opcode]
        compile_expression(tree_of_payload(encode_words(words)), F.col, options=Options(degrees=False, bores={1.0: 15.0}))
    assert row.select(compile_expression(tree_of_payload(encode_words([*attr("A"), 1010])), F.col, options=Options(bores={1.0: 15.0})).alias("x")).first().x == 15.0
    assert len(INFIX) == 13


@pytest.mark.parametrize(
    ("value", "pattern", "matches"),
    [("a_b", "a_b", True), ("axb", "a_b", False), ("50%", "50%", True), ("500", "50%", False), ("a\\b", "a\\b", True), ("abc", "a*", True), ("abc", "a?", False), ("a*", "?*", True), ("", "*", True), (None, "*", None)],
)
def test_wildcards(spark, value, pattern, matches):
    tree = tree_of_payload(encode_words([*attr("NAME"), *text(pattern), 1315]))
    assert spark.createDataFrame([(value,)], "NAME string").select(compile_expression(tree, F.col)).first()[0] is matches


@pytest.mark.parametrize(("value", "by", "parts"), [("a.b", ".", ["a", "b"]), ("a|b|", "|", ["a", "b", ""]), ("a\\Eb", "\\E", ["a", "b"]), ("ab", "", ["ab"]), ("", ",", [""]), (None, ",", None), ("a+b", "a+b", ["", ""])])
def test_splitting(spark, value, by, parts):
    tree = tree_of_payload(encode_words([*attr("NAME"), *text(by), 1829]))
    assert spark.createDataFrame([(value,)], "NAME string").select(compile_expression(tree, F.col)).first()[0] == parts


def test_opcodes_of_rows(spark):
    payloads = [encode_words([*n(1), *n(2), 602]), encode_words([*n(1), 9999]), None, b"\0", encode_words([*n(1), *n(2), 602])]
    found = opcode_histogram(spark.createDataFrame([(p,) for p in payloads], "payload binary").withColumn("n", F.lit(0)))
    assert sorted(map(tuple, found.collect())) == [(0x65, 5, True), (602, 2, True), (9999, 1, False)]
    assert opcode_histogram(spark.createDataFrame([], "payload binary")).count() == 0


def test_attribute_of_another_element(spark):
    of = lambda ref0, ref1: [*attr("MASS"), 1602, 5, ref0, ref1, 0, 0]
    tree = tree_of_payload(encode_words([*attr("MASS"), *of(13, 7), 802, *of(13, 8), 805]))
    assert to_text(tree) == "(ATTRIB MASS + (ATTRIB MASS OF =13/7)) / (ATTRIB MASS OF =13/8)" and other_elements(tree) == [("MASS", 13, 7), ("MASS", 13, 8)]
    attrs = spark.createDataFrame([(13, 7, 1, "MASS", 5.0), (13, 7, 3, "MASS", 9.0), (13, 7, 4, "ANGL", 1.0), (13, 8, 1, "MASS", 4.0), (13, 9, 9, "MASS", 0.0)], "ref0 bigint, ref1 bigint, sesno int, key string, value double")
    rows = spark.createDataFrame([(3.0,), (None,)], "MASS double")
    column = compile_expression(tree, F.col, other=values_of_others(tree, attrs))
    assert [r[0] for r in rows.select(column).collect()] == [3.0, None]
    missing = tree_of_payload(encode_words([*of(1, 1)]))
    assert rows.select(compile_expression(missing, F.col, other=values_of_others(missing, attrs))).first()[0] is None
    with pytest.raises(ExpressionError):
        compile_expression(missing, F.col)
    assert other_elements(tree_of_payload(encode_words([*attr("MASS"), 1602, 5, 0, 1701, 0, 0]))) == []


def test_fortieths(spark):
    from elemlake.functions.literals import fortieths

    rows = spark.createDataFrame([(19,), (3,), (7,), (100,), (-3,), (None,)], "raw int").select(fortieths(F.col("raw"), 2).alias("two"), fortieths(F.col("raw"), 3).alias("three")).collect()
    assert [r.two for r in rows] == [0.47, 0.07, 0.17, 2.5, -0.08, None] and [r.three for r in rows] == [0.475, 0.075, 0.175, 2.5, -0.075, None]
