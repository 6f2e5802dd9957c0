"""Binary stores as tables: a Python data source, one input partition per file and session.

    spark.dataSource.register(StoreSource)
    spark.read.format("elemlake_store").option("table", "elements").load("/folder/*.db")

Tables: headers, sessions, index, elements, attributes. The options
min_sesno and max_sesno, and with push=true and
spark.sql.python.filterPushdown.enabled filters on sesno, prune sessions before any of their pages are read;
table keeps element decoding out of header and index reads. The option layout
(layout_option() makes it of a noun_layout table) adds the attributes of the records' fixed parts.
Only files that the driver and all executors can open by path are read.

A record that cannot be read is a row with its key, its address and the reason in ``error``;
the option errors=fail makes it an error instead. elements and attributes need every index page of their session; one that cannot be
read is an error. read_store() reads such files by a scan for records
instead (tables damage, scanned_elements and scanned_attributes), a partition
per segment_bytes of a file.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMAS = {
    "headers": "path string, dbnum int, latest_ses_pgno bigint, session_page_no bigint, page_size int, stored_page_count bigint, bytes bigint",
    "sessions": "path string, dbnum int, sesno int, ses_pgno bigint, prev_ses_pgno bigint, start_pgno bigint, end_pgno bigint, index_root_pgno bigint, claim_pgno bigint, ts timestamp, computer_name string, comments string",
    "index": "dbnum int, sesno int, page_no bigint, level int, ord int, ref0 bigint, ref1 bigint, child_pgno bigint, offset_words int, flag int",
    "elements": "dbnum int, ref0 bigint, ref1 bigint, sesno int, byte_offset bigint, noun string, owner_ref0 bigint, owner_ref1 bigint, name string, children array<struct<ref0:bigint,ref1:bigint>>, error string",
    "attributes": "dbnum int, ref0 bigint, ref1 bigint, sesno int, key string, tag string, v_int bigint, v_double double, v_bool boolean, v_str string, v_ints array<int>, v_doubles array<double>, v_refs array<struct<ref0:bigint,ref1:bigint>>, error string",
    "damage": "path string, pages array<bigint>, ref0s array<bigint>",
}
SCHEMAS["scanned_elements"] = f"path string, {SCHEMAS['elements']}"
SCHEMAS["scanned_attributes"] = f"path string, byte_offset bigint, {SCHEMAS['attributes']}"
SEGMENT_BYTES = 16 << 20
EXTENSIONS_SKIPPED = ("com", "mis")


@dataclass
class _Part(InputPartition):
    path: str
    sesno: int | None = None
    first_pgno: int = 0
    end_pgno: int = 0
    root: int = 0

    start: int = 0
    end: int = 0

    def __init__(self, path: str, sesno: int | None = None, first_pgno: int = 0, end_pgno: int = 0, root: int = 0, start: int = 0, end: int = 0):
        super().__init__(0)
        self.path, self.sesno, self.first_pgno, self.end_pgno, self.root, self.start, self.end = path, sesno, first_pgno, end_pgno, root, start, end


def _store(path: str):
    from elemlake.codec.store import Store

    file = open(path, "rb")

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return Store(read)


def _sessions(path: str) -> list:
    from elemlake.codec.store import StoreError

    store = _store(path)
    found = store.sessions()
    if not found and store.cut(found):
        raise StoreError(f"no session page can be read in {path}")
    return found


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "elemlake_store"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "elements")]

    def reader(self, schema: StructType) -> "StoreReader":
        return (PushingReader if self.options.get("push") == "true" else StoreReader)(dict(self.options))


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "elements")
        self.low, self.high = int(options.get("min_sesno", "0")), int(options.get("max_sesno", str(1 << 31)))
        self.segment = int(options.get("segment_bytes", str(SEGMENT_BYTES)))
        self.fail = options.get("errors", "row") == "fail"
        self.layout = json.loads(options.get("layout", "{}"))
        self.ref0s = {p: set(x) for p, x in json.loads(options.get("ref0s", "{}")).items()}
        self.paths = sorted(p for pattern in options["path"].split(",") for p in (glob.glob(pattern) if glob.has_magic(pattern) else [pattern]) if not p.endswith(EXTENSIONS_SKIPPED))

    def _layouts(self):
        from elemlake.codec.store import Place

        return {noun: [Place(*p) for p in places] for noun, places in self.layout.items()} or None

    def partitions(self) -> list[InputPartition]:
        if self.table in ("headers", "sessions", "damage"):
            return [_Part(p) for p in self.paths]
        if self.table.startswith("scanned_"):
            return [_Part(p, start=at, end=min(at + self.segment, size)) for p in self.paths for size in [os.path.getsize(p)] for at in range(0, size, self.segment)]
        # Only headers and session pages are read here: a few pages a session.
        return [_Part(p, s.sesno, s.first_pgno, s.end_pgno, s.index_root_pgno) for p in self.paths for s in _sessions(p) if self.low <= s.sesno <= self.high]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        store = _store(partition.path)
        db = store.header["db_num"]
        if self.table == "headers":
            h = store.header
            yield partition.path, db, h["latest_ses_pgno"], h["session_page_no"], store.page_size, h["stored_page_count"], os.path.getsize(partition.path)
        elif self.table == "sessions":
            for s in store.sessions():
                if self.low <= s.sesno <= self.high:
                    yield partition.path, db, s.sesno, s.ses_pgno, s.prev_ses_pgno, s.first_pgno, s.end_pgno, s.index_root_pgno, s.claim_pgno, s.ts, s.computer_name, s.comments
        elif self.table == "index":
            for e in store.entries(partition.root, least_page=partition.first_pgno):
                if partition.first_pgno <= e.page <= partition.end_pgno:  # pages that this session wrote
                    yield db, partition.sesno, e.page, e.level, e.ord, e.ref0, e.ref1, e.child_pgno, e.offset_words, e.flag
        elif self.table == "damage":
            pages = store.damage()
            yield partition.path, pages, sorted(store.known_ref0s(os.path.getsize(partition.path))) if pages else []
        elif self.table.startswith("scanned_"):
            yield from self._scanned(store, db, partition)
        else:
            yield from self._elements(store, db, partition)

    def _elements(self, store, db: int, part: InputPartition) -> Iterator[tuple]:
        from elemlake.codec.store import StoreError

        layouts = self._layouts()
        # Pages of earlier sessions hold earlier records, which those sessions' partitions read.
        for key, e in store.newest(part.root, strict=True, least_page=part.first_pgno).items():
            if not part.first_pgno <= e.child_pgno <= part.end_pgno:
                continue
            at = store.address(e)
            try:
                x = store.record(at, layouts)
            except StoreError as error:
                if self.fail:
                    raise
                yield self._unread(db, key, part.sesno, at, str(error))
                continue
            yield from self._rows(db, key, part.sesno, at, x)

    def _unread(self, db: int, key: tuple[int, int], sesno: int, at: int, error: str) -> tuple:
        return (db, *key, sesno, at, *[None] * 5, error) if self.table == "elements" else (db, *key, sesno, *[None] * 9, error)

    def _scanned(self, store, db: int, part: InputPartition) -> Iterator[tuple]:
        sessions = store.sessions()
        if store.cut(sessions):  # where the oldest session that is left begins is not known
            sessions = sessions[1:]
        for at, x in store.scan(self.ref0s[part.path], part.start, part.end, self._layouts()):
            sesno = next((s.sesno for s in sessions if s.first_pgno <= at // store.page_size <= s.end_pgno), None)
            if sesno is None or self.low <= sesno <= self.high:
                first = (part.path,) if self.table == "scanned_elements" else (part.path, at)
                for row in self._rows(db, x.refno, sesno, at, x):
                    yield *first, *row

    def _rows(self, db: int, key: tuple[int, int], sesno: int | None, at: int, x) -> Iterator[tuple]:
        if self.table.endswith("elements"):
            yield db, *key, sesno, at, x.noun, *x.owner, x.attrs.get("NAME", (None, None))[1], x.children, None
            return
        for name, (kind, value) in x.attrs.items():
            refs = [value] if kind == "element" else value if kind == "refs" else None
            yield (
                db, *key, sesno, name, kind,
                value if kind == "int" else None, value if kind == "double" else None, value if kind == "bool" else None, value if kind == "string" else None,
                value if kind in ("ints", "words") else None, value if kind == "doubles" else None, refs, None,
            )


class PushingReader(StoreReader):
    """A reader that takes filters; Spark refuses one where their pushdown is not enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the sessions by what compares sesno with a number; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("sesno",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f


def layout_option(layout) -> str:
    """The option value of a noun_layout table, which is schema: a few rows a noun."""
    places: dict[str, list] = {}
    for r in layout.select("noun", "attr", "word_offset", "bit_index", "attr_type", "is_expr").where("noun is not null and attr is not null and word_offset is not null").distinct().collect():
        places.setdefault(r["noun"], []).append([r["attr"], r["word_offset"], r["bit_index"] or 0, r["attr_type"], bool(r["is_expr"])])
    return json.dumps(places)


def read_store(spark, path: str, table: str = "elements", **options):
    """elements or attributes of stores, whether their index can be read or not.

    Files with an unreadable index or session page are scanned by segments. Of the records of a key
    the one with the largest address stays per session, or at all where the
    session is not known. Removals are not seen by a scan. A file without any readable leaf
    page is an error, as a scan does not know its keys.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from elemlake.codec.store import StoreError

    read = lambda t, paths, **o: spark.read.format("elemlake_store").option("table", t).options(**options, **o).load(paths)
    files = read("damage", path).collect()  # a row per file
    whole, broken = ([f for f in files if bool(f.pages) is bad] for bad in (False, True))
    if lost := [f.path for f in broken if not f.ref0s]:
        raise StoreError(f"no leaf page can be read in {lost}")
    parts = [read(table, ",".join(glob.escape(f.path) for f in whole) or path)] if whole or not broken else []
    if broken:
        scanned = read(f"scanned_{table}", ",".join(glob.escape(f.path) for f in broken), ref0s=json.dumps({f.path: f.ref0s for f in broken}))
        newest = F.max("byte_offset").over(Window.partitionBy("path", "ref0", "ref1", "sesno"))
        parts.append(scanned.withColumn("_newest", newest).where("byte_offset = _newest").select(*StructType.fromDDL(SCHEMAS[table]).names))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_stores(versions, folder: str, bits: int = 12) -> int:
    """Writes versions as stores into a folder that all executors share, a file per database and 2^bits neighbouring refnos, a commit per session; how many files.

    A file is written by one task and holds at most the versions of its refnos. It appears under its name when it is whole, so a task that is run again does no harm.
    """
    from pyspark.sql import functions as F

    from elemlake.operators.lookup import standing

    local = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")

    def build(key, rows):
        import pandas as pd

        from elemlake.codec.store import Element, Writer

        dbnum, ref0, block = (int(k) for k in key)
        writer = Writer(dbnum)
        for sesno, part in rows.sort_values(["sesno", "ref1"]).groupby("sesno"):
            live = part[~part["deleted"]]
            elements = [
                Element((int(r.ref0), int(r.ref1)), r.noun, (int(r.owner_ref0), int(r.owner_ref1)), [] if r.children is None else [(c["ref0"], c["ref1"]) for c in r.children], {"NAME": ("string", r.name or "")})
                for r in live.itertuples(index=False)
            ]
            writer.commit(int(sesno), elements, tuple((int(r.ref0), int(r.ref1)) for r in part[part["deleted"]].itertuples(index=False)))
        os.makedirs(local, exist_ok=True)
        name = f"{local}/{dbnum}_{ref0}_{block}"
        with open(f"{name}.{os.getpid()}", "wb") as file:
            file.write(writer.bytes())
        os.replace(f"{name}.{os.getpid()}", f"{name}.db")
        return pd.DataFrame({"files": [1]})

    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = standing(versions).where("dbnum is not null and ref0 is not null and ref1 is not null and sesno is not null").select("dbnum", "ref0", "ref1", "sesno", "noun", "name", "deleted", "children", zero("owner_ref0"), zero("owner_ref1"), F.shiftright("ref1", bits).alias("block"))
    return rows.groupBy("dbnum", "ref0", "block").applyInPandas(build, "files int").agg(F.count(F.lit(1)).alias("n")).first()["n"]


def save_offsets(index_map, path: str, page_size: int) -> None:
    """The index map as Parquet with the page size it holds for."""
    from pyspark.sql import functions as F

    index_map.withColumn("page_size", F.lit(page_size)).write.mode("overwrite").parquet(path)


def load_offsets(spark, path: str, page_size: int):
    """A saved index map; another page size is an error, checked by one aggregate over a constant column."""
    from pyspark.sql import functions as F

    saved = spark.read.parquet(path)
    sizes = [r[0] for r in saved.select("page_size").distinct().limit(2).collect()]
    if sizes and sizes != [page_size]:
        raise ValueError(f"the index map is for pages of {json.dumps(sizes)} bytes, not {page_size}")
    return saved.drop("page_size").withColumn("addresses", F.array_sort(F.array_distinct("addresses")))
