"""Content-defined chunks: cutting binaries where their content says, storing each chunk once, and copying only what is missing.

A cut falls where a rolling hash over eight bytes has zeros at the end, so
an insertion moves only the cuts around it. Chunk contents stay where they
were cut: only hashes and lengths travel between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SCHEMA = "path string, ord int, start bigint, length int, hash binary"


def _table() -> np.ndarray:
    """A fixed random word per byte value."""
    return np.array([int.from_bytes(blake2b(bytes([b]), digest_size=8).digest(), "big") for b in range(256)], dtype="uint64")


def cut_positions(data: bytes, bits: int = 12, least: int = 256, most: int = 1 << 16) -> list[int]:
    """Ends of the chunks: where the hash of the eight bytes before has `bits` zeros, but no chunk shorter than least or longer than most."""
    n = len(data)
    if n == 0:
        return []
    values = _table()[np.frombuffer(data, dtype="uint8")]
    rolling = np.zeros(max(n - WINDOW + 1, 0), dtype="uint64")
    for i in range(WINDOW):
        part = values[i : n - WINDOW + 1 + i]
        turn = np.uint64(WINDOW - 1 - i)
        rolling ^= (part << turn) | (part >> (np.uint64(64) - turn)) if turn else part
    marks = np.flatnonzero(rolling & np.uint64((1 << bits) - 1) == 0) + WINDOW
    ends, start = [], 0
    for mark in map(int, marks):
        while mark - start > most:
            start += most
            ends.append(start)
        if mark - start >= least and mark < n:
            ends.append(mark)
            start = mark
    while n - start > most:
        start += most
        ends.append(start)
    return [*ends, n]


def chunk_table(files: DataFrame, bits: int = 12) -> DataFrame:
    """files (path, content) as chunks in order: (path, ord, start, length, hash)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                start = 0
                for i, end in enumerate(cut_positions(content or b"", bits)):
                    rows.append((path, i, start, end - start, blake2b(content[start:end], digest_size=32).digest()))
                    start = end
            yield pd.DataFrame(rows, columns=["path", "ord", "start", "length", "hash"]).astype({"ord": "int32", "start": "int64", "length": "int32"})

    return files.select("path", "content").mapInPandas(cut, SCHEMA)


def chunk_contents(files: DataFrame, bits: int = 12) -> DataFrame:
    """The archive of files: (hash, content), each distinct chunk once. Equal chunks are reduced to one before they move."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}
            for content in batch["content"]:
                start = 0
                for end in cut_positions(content or b"", bits):
                    rows.setdefault(blake2b(content[start:end], digest_size=32).digest(), content[start:end])
                    start = end
            yield pd.DataFrame(list(rows.items()), columns=["hash", "content"])

    return files.select("content").mapInPandas(cut, "hash binary, content binary").dropDuplicates(["hash"])


def rebuild(chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """The files of a chunk table from contents: (path, content, missing). contents may come from an archive, from seeds that are at hand, or both.

    A file is put together in one row, as it was read; missing counts its chunks without content, and such a file has none.
    """
    known = contents.dropDuplicates(["hash"]).select("hash", "content")
    placed = chunks.join(known, "hash", "left")
    files = placed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("parts"), F.count_if(F.col("content").isNull()).alias("missing"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["content"]))
    return files.select("path", F.when(F.col("missing") == 0, whole).alias("content"), "missing")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """(hash, length, uses): the dictionary of the archive."""
    return chunks.groupBy("hash").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("uses"))


def missing_chunks(wanted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct chunks of wanted that no seed has: what a copy must fetch."""
    return distinct_chunks(wanted).join(seeds.select("hash").distinct(), "hash", "left_anti")


def saving(chunks: DataFrame) -> DataFrame:
    """(bytes, stored_bytes, n_chunks, n_distinct)"""
    return distinct_chunks(chunks).agg(F.sum(F.col("length").cast("bigint") * F.col("uses")).alias("bytes"), F.sum(F.col("length").cast("bigint")).alias("stored_bytes"), F.sum("uses").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"))
