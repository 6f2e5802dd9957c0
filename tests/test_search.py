"""Searches of every field by brute force: words that stand only in an attribute's key or value are found."""

from __future__ import annotations

import json
import re

import __spark_entry__
from tests.test_problems import CHANGES

ADDED = [
    (1, "PIPE", {"NAME": "/A", "DESC": "North cooler"}), (2, "PIPE", {"NAME": "/north-1"}), (3, "VALV", {"NAME": "/B", "NORTHING": 5}), (4, "VALV", {"NAME": "/C", "DESC": "support frame", "POS": [1, "northern"]}),
    (5, "PIPE", {"NAME": "/pipe/5", "DESC": None}), (6, "VALV", {"DESC": "f suport"}), (7, "PIPE", None), (8, "VALV", {"NAME": "/D", "DESC": "south"}), (9, "PIPE", {"NAME": "/cooler"}),
]


def words(ref1, kind, attrs):
    found = set(re.findall(r"[^\W_]+", f"{(attrs or {}).get('NAME', '')} {kind} 1 {ref1}".lower()))
    for k, v in (attrs or {}).items():
        found |= set(re.findall(r"[^\W_]+", f"{k} {'' if v is None else json.dumps(v)}".lower()))
    return found


def begins(word):
    return {f"1_{r}_5" for r, kind, attrs in ADDED if any(w.startswith(word) for w in words(r, kind, attrs))}


def test_attributes_are_searched(spark, tmp_path):
    rows = [(r, 1, 1, r, 5, r, "Add", kind, None, None if attrs is None else json.dumps({"whole_attmap": attrs})) for r, kind, attrs in ADDED]
    spark.createDataFrame(rows, CHANGES).write.parquet(f"{tmp_path}/changes.parquet")
    ask = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path))
    ids = lambda name: {r.id for r in ask(name).collect()}
    assert tuple(ask("search_stats").first()) == (len(begins("north")), 4) and len(begins("north")) == 4
    assert ids("search_advanced") == begins("cooler") == {"1_1_5", "1_9_5"}
    assert ids("search_by_type") == {f"1_{r}_5" for r, kind, _ in ADDED if kind == "PIPE"}
    assert ids("search_fuzzy") == {"1_4_5", "1_6_5"}
