"""The attribute dictionary: attributes with type, storage, unit and category, and which noun has which.

A dictionary is a file of 2,048-byte pages of big-endian words. Page 1 is
its directory: word 1 names the first page of the attribute records, word 3
that of the noun entries, and any other word may name a page at which one of three further
sections begins. Sections end with the delimiter word, or where nothing fits their form.

* Attribute records stand between delimiters: an id, the name behind its
  length (a character a word), the unit class, then texts among other words: description, short name, name on screen, category.
* Noun entries are triples: noun hash, position of the attribute among the records, type code.
* Definitions are triples of hash, type and kind; kind 2 has its default behind
  it: a length and words for a reference type, else one word.
* The name index has pairs of hash and place (page and word in one number).
* The syntax section has triples whose first word is no name.

Defined results: a file that ends early gives what it has; a section that no page begins is empty;
an attribute without a definition has type Unknown; entries that point at no attribute are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.functions.names import python_name_hash, python_name_of_hash

# Names of the type codes, storage classes and unit classes; page size, section delimiter, range of the hashes of names, places in the directory.
TYPES = {1: "Integer", 2: "Real", 3: "Boolean", 4: "Reference", 5: "Text", 6: "Enum", 7: "Position", 8: "Direction", 9: "Orientation", 10: "IntArray", 11: "RealArray", 12: "RefArray"}
STORAGE = {1: "DAB", 4: "Pseudo"}
UNITS = {1: "Dimensionless", 2: "Distance/Area/Bore", 3: "Temperature/Pressure", 4: "Volume", 5: "Angle", 6: "Mass"}
PAGE, DELIMITER, NAME_HASHES = 2048, 0xFFFFFFFF, range(531_442, 387_951_930)
RECORDS_WORD, NOUNS_WORD, WITH_DEFAULT, REFERENCE_TYPE = 1, 3, 2, 4
PAGE_WORDS, MOST_TEXT, MOST_UNIT = PAGE // 4, 500, 20

ATTRIBUTES = "position int, attr_id bigint, attr_hash bigint, name string, data_type string, storage string, size int, unit_type int, unit_name string, description string, short_name string, screen_name string, category string"
NOUNS = "noun_hash bigint, noun string, attr_index int, type_code int"


@dataclass
class Record:
    """An attribute record."""

    id: int
    name: str
    unit: int
    texts: list[str]


@dataclass
class Dictionary:
    records: list[Record] = field(default_factory=list)
    nouns: list[tuple[int, int, int]] = field(default_factory=list)
    definitions: list[tuple[int, int, int, int]] = field(default_factory=list)  # hash, type, kind, place of the default, 0 if none
    defaults: list[int] = field(default_factory=list)
    index: list[tuple[int, int, int]] = field(default_factory=list)  # hash, page, word
    syntax: list[tuple[int, int, int]] = field(default_factory=list)


# Reading


def _pages(data: bytes) -> list[tuple[int, ...]]:
    return [struct.unpack_from(f">{PAGE_WORDS}I", data, at) for at in range(0, len(data) - PAGE + 1, PAGE)]


def _records(pages: list[tuple[int, ...]], start: int) -> list[list[int]]:
    """The words between delimiters, over pages; the first one opens the section."""
    out: list[list[int]] = []
    for page in pages[start:]:
        for w in page:
            if w == DELIMITER:
                out.append([])
            elif out:
                out[-1].append(w)
    return [r for r in out if any(r)]


def _text(words: list[int], at: int) -> tuple[str, int] | None:
    """The text whose length stands at a place, if all its characters can be printed."""
    n = words[at] if at < len(words) else 0
    chars = words[at + 1 : at + 1 + n]
    return ("".join(map(chr, chars)), at + 1 + n) if 0 < n < MOST_TEXT and len(chars) == n and all(0x20 <= c <= 0x7E for c in chars) else None


def _record(words: list[int]) -> Record | None:
    at = next(i for i, w in enumerate(words) if w)
    named = _text(words, at + 1)
    if named is None:
        return None
    name, after = named
    unit = words[after] if after < len(words) else 0
    texts, i = [], after + 1
    while i < len(words):
        found = _text(words, i)
        if found:
            texts.append(found[0])
        i = found[1] if found else i + 1
    return Record(words[at], name, unit if unit <= MOST_UNIT else -1, texts)


def _tuples(pages: list[tuple[int, ...]], start: int, width: int, names: bool) -> list[tuple[int, ...]]:
    """Tuples that no page's end cuts, up to the delimiter; a zero or a first word of another kind ends a page, a page without any the section."""
    out: list[tuple[int, ...]] = []
    for page in pages[start:]:
        found = 0
        for at in range(0, PAGE_WORDS - width + 1, width):
            first = page[at]
            if first == DELIMITER:
                return out
            if first == 0 or names and first not in NAME_HASHES:
                break
            out.append(page[at : at + width])
            found += 1
        if not found:
            break
    return out


def _definitions(pages: list[tuple[int, ...]], start: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    out: list[tuple[int, int, int, int]] = []
    defaults: list[int] = []
    for page in pages[start:]:
        at, found = 0, 0
        while at + 3 <= PAGE_WORDS and page[at] != DELIMITER and page[at] in NAME_HASHES:
            name, kind, how = page[at : at + 3]
            at, place = at + 3, 0
            if how == WITH_DEFAULT:
                place = len(defaults) + 1
                n = 1 + page[at] if kind == REFERENCE_TYPE and at < PAGE_WORDS else 1
                defaults += page[at : at + n]
                at += n
            out.append((name, kind, how, place))
            found += 1
        if not found or at < PAGE_WORDS and page[at] == DELIMITER:
            break
    return out, defaults


def _kind_of(page: tuple[int, ...]) -> str | None:
    """Which of the three further sections a page can begin."""
    if page[0] in (0, DELIMITER):
        return None
    if page[0] not in NAME_HASHES:
        return "syntax"
    # The second word of a definition is a small type code, that of an index pair a place behind the first pages.
    return "definitions" if page[1] in TYPES and 0 < page[2] <= max(STORAGE) else "index"


def decode_dictionary(data: bytes) -> Dictionary:
    pages = _pages(data)
    out = Dictionary()
    if len(pages) < 2:
        return out
    directory = pages[1]
    if 0 < directory[RECORDS_WORD] < len(pages):
        out.records = [r for r in map(_record, _records(pages, directory[RECORDS_WORD])) if r]
    if 0 < directory[NOUNS_WORD] < len(pages):
        out.nouns = [t for t in _tuples(pages, directory[NOUNS_WORD], 3, False) if 0 < t[1] <= len(out.records)]
    seen = set()
    for start in sorted(set(directory) - {0, DELIMITER, directory[RECORDS_WORD], directory[NOUNS_WORD]}):
        kind = _kind_of(pages[start]) if start < len(pages) else None
        if kind is None or kind in seen:
            continue
        seen.add(kind)
        if kind == "definitions":
            out.definitions, out.defaults = _definitions(pages, start)
        elif kind == "index":
            out.index = [(name, place // PAGE_WORDS, place % PAGE_WORDS) for name, place in _tuples(pages, start, 2, True)]
        else:
            out.syntax = _tuples(pages, start, 3, False)
    return out


def attribute_rows(found: Dictionary) -> list[tuple]:
    """Rows of ATTRIBUTES: records with what their definitions say."""
    defined = {name: (kind, how, place) for name, kind, how, place in found.definitions}
    rows = []
    for i, r in enumerate(found.records):
        try:
            hashed = python_name_hash(r.name.lstrip(":"))
        except ValueError:
            hashed = None
        kind, how, place = defined.get(hashed, (0, 0, 0))
        texts = [*r.texts, "", "", "", ""][:4]
        rows.append((i, r.id, hashed, r.name, TYPES.get(kind, "Unknown"), STORAGE.get(how, "Unknown"), max(place, 1), r.unit, "Invalid" if r.unit < 0 else UNITS.get(r.unit, "Unknown"), *texts))
    return rows


def noun_rows(found: Dictionary) -> list[tuple]:
    return [(h, python_name_of_hash(h) or f"HASH_{h}", i, t) for h, i, t in found.nouns]


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attributes and noun entries of dictionary files as tables, each file read by one task: it is schema, a few pages."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows_of(rows, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    yield pd.DataFrame(rows(decode_dictionary(bytes(content))), columns=names)

        return files.mapInPandas(decode, schema)

    return rows_of(attribute_rows, ATTRIBUTES), rows_of(noun_rows, NOUNS)


# Writing


def encode_dictionary(found: Dictionary) -> bytes:
    """A file that decode_dictionary() reads; tuples and definitions are not cut by pages."""
    directory = [0] * PAGE_WORDS
    pages: list[list[int]] = [[0] * PAGE_WORDS, directory]

    def add(parts: list[list[int]], whole: bool) -> int:
        """Appends words page by page, parts whole where told, and gives the first page."""
        start, page = len(pages), []
        for part in parts:
            if whole and len(page) + len(part) > PAGE_WORDS - 1:
                pages.append(page + [0] * (PAGE_WORDS - len(page)))
                page = []
            page += part
            while not whole and len(page) >= PAGE_WORDS:
                pages.append(page[:PAGE_WORDS])
                page = page[PAGE_WORDS:]
        pages.append(page + [0] * (PAGE_WORDS - len(page)))
        return start

    text = lambda t: [len(t), *map(ord, t)]
    end = [[DELIMITER]]
    directory[RECORDS_WORD] = add([[DELIMITER, r.id, *text(r.name), r.unit & 0xFFFFFFFF, *(w for t in r.texts if t for w in text(t))] for r in found.records] + end, False)
    directory[NOUNS_WORD] = add([list(t) for t in found.nouns] + end, True)
    defaults = lambda kind, place: ([] if not place else found.defaults[place - 1 : place + found.defaults[place - 1]] if kind == REFERENCE_TYPE else [found.defaults[place - 1]])
    if found.definitions:
        directory[5] = add([[name, kind, how, *defaults(kind, place)] for name, kind, how, place in found.definitions] + end, True)
    if found.index:
        directory[6] = add([[name, page * PAGE_WORDS + at] for name, page, at in found.index] + end, True)
    if found.syntax:
        directory[7] = add([list(t) for t in found.syntax] + end, True)
    return b"".join(struct.pack(f">{PAGE_WORDS}I", *p) for p in pages)


def noun_schema(attributes: DataFrame, nouns: DataFrame, first_index: int = 0) -> DataFrame:
    """(noun, attr, data_type, type_code): nouns joined with their attributes by position; first_index is the position of the first."""
    order = attributes.select((F.col("position") + first_index).alias("attr_index"), F.col("name").alias("attr"), "data_type")
    return nouns.join(order, "attr_index", "left").select("noun", "attr", F.coalesce("data_type", F.lit("Unknown")).alias("data_type"), "type_code")


def schema_filter(layout: DataFrame, attr_type: str | None = None, name: str | None = None, expressions: bool | None = None) -> DataFrame:
    """Rows of a layout by type, by name without regard to case, and by whether they hold expressions."""
    rows = layout
    if attr_type is not None:
        rows = rows.where(F.col("attr_type") == attr_type)
    if name is not None:
        rows = rows.where(F.upper("attr") == name.upper())
    if expressions is not None:
        rows = rows.where(F.col("is_expr") == expressions)
    return rows
