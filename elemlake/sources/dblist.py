"""Text dumps of elements as attribute rows.

A dump holds elements between INPUT BEGIN and INPUT END (or FINISH). ``NEW kind name``
begins one, END closes it, any other line is a key and a value; a value
that ends in ``$`` goes on in the next line. Lines of ``--`` are comments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source string, elem_no int, kind string, name string, attr_no int, key string, value string"


@dataclass
class Dump:
    elements: list[tuple[str, str | None, list[list[str]]]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def parse_dump(text: str) -> Dump:
    """Elements with their attributes in order. Stray END lines are passed over; lines outside an element are warned of."""
    dump, inside, current, goes_on = Dump(), False, None, False
    for number, raw in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = " ".join(raw.split())
        if not line or line.startswith("--"):
            continue
        if not inside:
            inside = line.startswith("INPUT BEGIN")
            continue
        if line.startswith(("INPUT END", "INPUT FINISH")):
            break
        if line == "END":
            current, goes_on = None, False
        elif line.startswith("NEW "):
            _, kind, *name = line.split(" ")
            current, goes_on = (kind, " ".join(name) or None, []), False
            dump.elements.append(current)
        elif current is None:
            dump.warnings.append(f"line {number}: not part of an element")
        else:
            key, _, value = ("", "", line) if goes_on else line.partition(" ")
            more = value.endswith("$")
            value = value.rstrip("$").rstrip()
            if not goes_on:
                current[2].append([key, value])
            elif value and current[2]:
                last = current[2][-1]
                last[1] = f"{last[1]} {value}" if last[1] else value
            goes_on = more
    return dump


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """All dumps below a path as rows of SCHEMA. A file is one element of work; Arrow carries the rows."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, text in zip(batch["source"], batch["value"]):
                for i, (kind, name, attrs) in enumerate(parse_dump(text or "").elements, 1):
                    out.extend((source, i, kind, name, j, key, value) for j, (key, value) in enumerate(attrs, 1))
            yield pd.DataFrame(out, columns=["source", "elem_no", "kind", "name", "attr_no", "key", "value"]).astype({"elem_no": "int32", "attr_no": "int32"})

    return files.mapInPandas(rows, SCHEMA)


def write_dump(elements: list[tuple[str, str | None, list[list[str]]]]) -> str:
    lines = ["INPUT BEGIN"]
    for kind, name, attrs in elements:
        lines.append(f"NEW {kind} {name or ''}".rstrip())
        lines.extend(f"{key} {value}".rstrip() for key, value in attrs)
        lines.append("END")
    return "\n".join([*lines, "INPUT END", ""])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Expression test cases from JSON ({description, cases}) or CSV: (name, refno, file_path, attr, expected, enabled)."""
    columns = ["name", "refno", "file_path", "attr", "expected"]
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns) + ", enabled boolean")
    else:
        case = "name:string,refno:string,file_path:string,fixture_path:string,attr:string,expected:string,enabled:boolean"
        rows = spark.read.json(path, schema=f"description string, cases array<struct<{case}>>", multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    return rows.select(*columns, F.coalesce("enabled", F.lit(True)).alias("enabled"))
