"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting and default for the folder with the vocabulary files, which every executor must see.
TOKENIZERS = ("spark.elemlake.tokenizers", "/opt/tokenizers")

# Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_dir(spark: SparkSession) -> str:
    return spark.conf.get(*TOKENIZERS)


def encoder(path: str):
    """A tokenizer from a file of ranks: a line per token, base64 and rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("elemlake", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str):
    """A Pandas UDF text -> number of tokens, over whole texts; null and empty texts have none. The vocabulary is read once a worker batch stream."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for texts in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def with_tokens(documents: DataFrame, text: Column | str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", out: str = "n_tokens") -> DataFrame:
    count = token_counter(f"{tokenizer_dir(documents.sparkSession)}/{vocabulary}")
    return documents.withColumn(out, count(text))
