"""Element search: documents, tokens, typo-tolerant matching, filters, order and paging.

Query words meet the distinct tokens of the corpus, not its rows: tokens are
counted once, the query's words are compared
with them, and documents join the few tokens that match. Ranking: exact before prefix
before one edit (words of five letters and more) or two (nine and more).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elemlake.operators.change_feed import operation

#: Words that are compared with the tokens in one expression; longer searches take several.
WORDS_AT_ONCE = 64
FILTERABLE = ("element_type", "operation_type", "sesno", "refno", "dbnum")
SORTABLE = ("sesno", "timestamp", "name", "refno")


def documents(changes: DataFrame) -> DataFrame:
    """One document per added element and session: (id, refno, name, element_type, sesno, operation_type, attributes_text, timestamp, dbnum).

    Only Add operations become documents; a missing name is the refno;
    attributes_text is key and value after one another.
    """
    rows = changes.withColumn("kind", operation(F.col("operation_type"))).where("kind = 'add' and ref0 is not null and ref1 is not null")
    first = rows.groupBy("dbnum", "ref0", "ref1", "sesno").agg(F.min(F.struct("op_no", F.col("details").isNull().alias("blank"), "change_id", "details", "entity_type", "ts")).alias("r"))
    attrs = F.map_entries(F.from_json("r.details", "whole_attmap map<string,string>")["whole_attmap"])
    text = F.array_join(F.transform(F.array_sort(attrs), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    name = F.get_json_object("r.details", "$.whole_attmap.NAME")
    refno = F.concat_ws("_", "ref0", "ref1")
    return first.select(
        F.concat_ws("_", "ref0", "ref1", "sesno").alias("id"), refno.alias("refno"), F.coalesce(name, refno).alias("name"), F.col("r.entity_type").alias("element_type"),
        "sesno", F.lit("Add").alias("operation_type"), F.coalesce(text, F.lit("")).alias("attributes_text"), F.col("r.ts").alias("timestamp"), "dbnum",
    )


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def query_words(query: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"[\W_]+", query.lower())) if w]


def token_score(token: Column, word: str) -> Column:
    """4 exact, 3 prefix, 2 one edit, 1 two edits, null no match."""
    score = F.when(token == word, 4).when(token.startswith(word), 3)
    edits = 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0
    if edits:
        near = F.abs(F.length(token) - len(word)) <= edits
        distance = F.levenshtein(token, F.lit(word), edits)
        score = score.when(near & (distance == 1), 2)
        if edits == 2:
            score = score.when(near & (distance == 2), 1)
    return score


def search(docs: DataFrame, query: str = "", filters: dict[str, object] | None = None, sort: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents that match every word, best first: the columns of docs and ``score``.

    filters are equalities, or ranges as (low, high) with None for an open end.
    sort is ``field:asc`` or ``field:desc``. An empty query matches everything.
    """
    rows = docs
    for name, wanted in (filters or {}).items():
        if name not in FILTERABLE and name != "timestamp":
            raise ValueError(f"{name} cannot be filtered")
        if isinstance(wanted, tuple):
            low, high = wanted
            rows = rows.where((F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high))
        else:
            rows = rows.where(F.col(name) == wanted)
    words = query_words(query)
    if words:
        text = F.concat_ws(" ", "name", "element_type", "attributes_text", "refno")
        placed = rows.select("id", F.explode(tokens_of(text)).alias("token"))
        distinct = placed.select("token").distinct()
        matching = None
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = list(enumerate(words))[start : start + WORDS_AT_ONCE]
            hits = F.array_compact(F.array(*[F.when(token_score(F.col("token"), w).isNotNull(), F.struct(F.lit(i).alias("word"), token_score(F.col("token"), w).alias("s"))) for i, w in some]))
            found = distinct.select("token", F.explode(hits).alias("h")).select("token", "h.*")
            matching = found if matching is None else matching.unionByName(found)
        per_word = placed.join(matching, "token").groupBy("id", "word").agg(F.max("s").alias("s"))
        scored = per_word.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").cast("int").alias("score")).where(F.col("n") == len(words)).drop("n")
        rows = rows.join(scored, "id")
    else:
        rows = rows.withColumn("score", F.lit(0))
    order = [F.desc("score")]
    if sort:
        field, _, direction = sort.partition(":")
        if field not in SORTABLE:
            raise ValueError(f"{field} cannot be sorted")
        order = [F.desc(field) if direction == "desc" else F.asc(field)]
    rows = rows.orderBy(*order, "id")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def search_by_type(docs: DataFrame, element_type: str, limit: int | None = None) -> DataFrame:
    """Documents of a type that also name it in their text: both the query and the filter."""
    return search(docs, element_type, {"element_type": element_type}, limit=limit)


def search_stats(docs: DataFrame, query: str, filters: dict[str, object] | None = None) -> DataFrame:
    """(n_hits, best_score)"""
    return search(docs, query, filters).agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best_score"))


def index_stats(docs: DataFrame) -> DataFrame:
    """How many documents have each field filled."""
    counts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().cast("bigint").alias("n")) for c in docs.columns])
    return docs.select(F.explode(counts).alias("c")).groupBy("c.field").agg(F.sum("c.n").alias("n"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """stored with new rows in place of those of the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key is not stored yet, each key once; null is a value of a key like any other."""
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.dropDuplicates(keys).join(known, same, "left_anti")

