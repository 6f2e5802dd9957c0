"""Texts of axes and parameters in the fixed part of records and in explicit attributes."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from elemlake.functions.expressions import ExpressionError, axis_text, explicit_axis
from elemlake.functions.literals import angle_or_number, implicit_axis, parameter

CASES = {
    (2, 1, 1): "X", (2, 1, 3): "Z", (2, 2, 2): "-Y", (2, 1, 9): None, (2, 3, 0): "P0", (2, 3, 2): "P2", (2, 3, 1000): "-P0", (2, 3, 1002): "-P2",
    (2, -12, 4500): "X 45 Y", (2, -15, -4550): "X -45 -Y", (2, -34, 9000): "Z 90 -X", (2, -61, 100): "-Z 1 X", (2, -17, 100): None, (2, -10, 100): None, (2, -70, 1): None,
    (2, 12, 3): "X PARAM 3 Y", (2, 23, 52): "Y DESIGN PARAM 2 Z", (2, 14, -4): "X DDANGLE -X", (2, 65, -455): "-Z 45.5 -Y", (2, 16, -450): "X 45 -Z", (4, 1, 1): None, (2, None, 1): None,
}


def test_axes_of_the_fixed_part(spark):
    rows = spark.createDataFrame(list(CASES), "flag int, kind int, value int")
    got = {(r.flag, r.kind, r.value): r.text for r in rows.select("*", implicit_axis(F.col("flag"), F.col("kind"), F.col("value")).alias("text")).collect()}
    assert got == CASES


def test_parameters(spark):
    want = {0: "PARAM 0", 49: "PARAM 49", 50: "DESIGN PARAM 0", 100: "DESIGN PARAM 50", 101: "IPARAM 1", 500: "IPARAM 400", 501: "TWICE PARAM 1", 549: "TWICE PARAM 49", 550: "TWICE DESIGN PARAM 0", 600: "TWICE DESIGN PARAM 50", 601: "IPARAM 1", 1000: "IPARAM 400", 1001: "", -5: "DDHEIGHT", -3: "DDRADIUS", -30: "3", -25: "2.5", None: None}
    rows = spark.createDataFrame([(k,) for k in want], "raw int").select("raw", parameter(F.col("raw")).alias("text"), angle_or_number(F.col("raw")).alias("number"))
    assert {r.raw: r.text for r in rows.collect()} == want


def number(n):
    return [0x65, 2, n]


def coordinate(code, n):
    body = number(n)
    return [code, len(body) + 2, 0, *body]


def payload(form, *rest, mark=2):
    words = [0x1A, 0x1A, 5, mark, form, *rest]
    return struct.pack(f">{len(words)}i", *words)


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (payload(0x16, *coordinate(11, 45), 13), "X ( 45 ) Y"), (payload(0x16, *coordinate(12, 45), 16), "AXIS -X ( 45 ) -Z"), (payload(0x17, *coordinate(11, 1), *coordinate(14, 2), 15), "X ( 1 ) -Y ( 2 ) Z"),
        (payload(0x22, 0x52, 3, 7, 4), "PP 4"), (payload(0x22, 0x52, 3, 8, 4), None), (payload(0x34, 0, 0x20, *coordinate(11, 1), *coordinate(14, 2)), "TO X ( 1 ) Y (NEG ( 2 )) "), (payload(0x34, 0, 9), None),
        (payload(7, 14, 61, mark=1), "-Y"), (payload(7, 14, 60, mark=1), None), (b"", None),
    ],
)
def test_axes_of_explicit_attributes(data, text):
    assert axis_text(data) == text


def test_axes_that_break_off(spark):
    broken = [payload(0x16, *coordinate(11, 45)), payload(0x17, 11, 90, 0), payload(0x34, 0, 0x21, *coordinate(11, 1))]
    for data in broken:
        with pytest.raises(ExpressionError):
            axis_text(data)
    rows = spark.createDataFrame([(x,) for x in [*broken, None, payload(0x22, 0x52, 3, 7, 4)]], "data binary")
    assert [r[0] for r in rows.select(explicit_axis("data")).collect()] == [None, None, None, None, "PP 4"]
