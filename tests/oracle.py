"""Spark result against DuckDB's over the same Parquet tables: columns, rows and values, whatever the order."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import numpy as np

DATA = os.environ.get("ELEMLAKE_TESTDATA", "/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(DATA, sf).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float) or isinstance(value, np.floating):
        return "nan" if value != value else round(float(value), 6)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return round(float(value), 6) if type(value).__name__ == "Decimal" else value
    return value


def rows_of_spark(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(tuple(r[c]) if type(r[c]).__name__ == "Row" else r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both agree."""
    names, want = rows_of_duck(con, sql)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {names}"
    got = rows_of_spark(df)
    if got == want:
        return ""
    from collections import Counter

    more, less = Counter(got) - Counter(want), Counter(want) - Counter(got)
    return f"{len(got)} rows instead of {len(want)}; too many: {list(more)[:4]}; missing: {list(less)[:4]}"
