"""Search, expression, codec, schema and streaming queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.functions.expressions import Options, compile_expression, encode_words, opcode_counts, to_text, tree_of_payload
from elemlake.functions.names import name_of_hash, parse_refno, python_name_hash, refno_text
from elemlake.operators import chunks, lookup, search
from elemlake.operators.change_feed import place
from elemlake.plans.lookup_queries import ORACLES as LOOKUP_SQL
from elemlake.plans.lookup_queries import STANDING
from elemlake.plans.workspace import new_path, write_bytes, written
from elemlake.sources.dictionary import schema_filter
from elemlake.streaming import feed
from elemlake.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Search

_DOCS = """
adds as (
  select * from (
    select *, row_number() over (partition by dbnum, ref0, ref1, sesno order by op_no, details is null, change_id) as n
    from changes where upper(trim(operation_type)) in ('ADD', '新增') and ref0 is not null and ref1 is not null) where n = 1),
docs as (
  select ref0 || '_' || ref1 || '_' || sesno as id, ref0 || '_' || ref1 as refno, coalesce(details->>'$.whole_attmap.NAME', ref0 || '_' || ref1) as name, entity_type as element_type, sesno, 'Add' as operation_type, ts as timestamp, dbnum,
    array_to_string(list_transform(list_sort(map_entries(cast(details->'$.whole_attmap' as map(varchar, varchar)))), lambda e: concat_ws(' ', e.key, e.value)), ' ') as attributes_text
  from adds)
"""
_WORDS = "array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(coalesce(attributes_text, '')), '[^\\p{L}\\p{N}]+')), lambda t: t <> '')), ' ')"
_TOKENS = "placed as (select distinct id, t.token from (select id, unnest(string_split_regex(lower(concat_ws(' ', name, element_type, refno, attributes_text)), '[^\\p{L}\\p{N}]+')) as token from docs) t where t.token <> '')"


def _score(token: str, word: str) -> str:
    edits = 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0
    cases = [f"when {token} = '{word}' then 4", f"when starts_with({token}, '{word}') then 3"]
    cases += [f"when levenshtein({token}, '{word}') = {e} then {3 - e}" for e in range(1, edits + 1)]
    return "case " + " ".join(cases) + " end"


def _search_sql(words: list[str], where: str = "true") -> str:
    scored = " union all ".join(f"select id, {i} as word, max({_score('token', w)}) as s from placed group by id having max({_score('token', w)}) is not null" for i, w in enumerate(words))
    return f"with {_DOCS}, {_TOKENS}, per_word as ({scored}), hits as (select id, cast(sum(s) as int) as score from per_word group by id having count(*) = {len(words)}) select id, refno, name, element_type, sesno, score from docs join hits using (id) where {where}"


@query(f"with {_DOCS} select id, refno, name, element_type, sesno, operation_type, timestamp, dbnum, {_WORDS} as words from docs")
def search_documents(spark, sf):
    """The words of the attributes stand for their text, whose numbers and brackets are spelled by each engine in its own way."""
    docs = search.documents(table(spark, sf, "changes"))
    return docs.select("id", "refno", "name", "element_type", "sesno", "operation_type", "timestamp", "dbnum", F.array_join(F.array_sort(search.tokens_of(F.col("attributes_text"))), " ").alias("words"))


@query(_search_sql(["suport", "f"]))
def search_fuzzy(spark, sf):
    return search.search(search.documents(table(spark, sf, "changes")), "suport f").select("id", "refno", "name", "element_type", "sesno", "score")


@query(_search_sql(["pipe"], "element_type = 'PIPE'"))
def search_by_type(spark, sf):
    return search.search_by_type(search.documents(table(spark, sf, "changes")), "PIPE").select("id", "refno", "name", "element_type", "sesno", "score")


@query(_search_sql(["cooler"], "sesno between 3 and 30") + " order by sesno desc, id limit 25")
def search_advanced(spark, sf):
    return search.search(search.documents(table(spark, sf, "changes")), "cooler", {"sesno": (3, 30)}, "sesno:desc", 25).select("id", "refno", "name", "element_type", "sesno", "score")


@query(f"select count(*) as n_hits, max(score) as best_score from ({_search_sql(['north'])})")
def search_stats(spark, sf):
    return search.search_stats(search.documents(table(spark, sf, "changes")), "north")


@query(f"with {_DOCS} select unnest(['id', 'refno', 'name', 'element_type', 'sesno', 'operation_type', 'attributes_text', 'timestamp', 'dbnum']) as field, unnest([count(id), count(refno), count(name), count(element_type), count(sesno), count(operation_type), count(*), count(timestamp), count(dbnum)]) as n from docs")
def search_index_stats(spark, sf):
    return search.index_stats(search.documents(table(spark, sf, "changes")))


@query(f"with {_DOCS} select refno, id, name, sesno from docs qualify row_number() over (partition by refno order by sesno desc, dbnum desc) = 1")
def search_upsert(spark, sf):
    """An index with one document an element, built from the first sessions and brought up to date by the others."""
    docs = search.documents(table(spark, sf, "changes"))

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("refno").agg(F.max(F.struct("sesno", "dbnum", "id", "name")).alias("d")).select("refno", "d.id", "d.name", "d.sesno")

    return search.upsert(newest(docs.where("sesno <= 20")), newest(docs.where("sesno > 20")), "refno")


# Expressions: (MASS / 2 + SQRT(ABS(ANGL))) and a condition, over the newest version's attributes


def _attribute(name: str) -> list[int]:
    return [0x6A, 0, python_name_hash(name), 0, 0, 0]


def _number(n: int) -> list[int]:
    return [0x65, 2, n]


EXPRESSIONS = {
    "load": [*_attribute("MASS"), *_number(2), 805, *_attribute("ANGL"), 1007, 1001, 802],
    "tilted": [*_attribute("ANGL"), 901, *_number(0), 601, *_attribute("MASS"), *_number(1000), 605, 302],
    "either": [*_attribute("MASS"), *_attribute("ANGL"), 1008, *_number(10), 803],
}


@query("""
with v as (select dbnum, ref0, ref1, sesno, key, max(coalesce(v_double, v_int)) as x from attrs_long where key in ('MASS', 'ANGL') group by 1, 2, 3, 4, 5),
w as (select dbnum, ref0, ref1, sesno, max(x) filter (key = 'MASS') as mass, max(x) filter (key = 'ANGL') as angl from v group by 1, 2, 3, 4)
select dbnum, ref0, ref1, sesno, round(mass / 2 + sqrt(abs(angl)), 6) as load, sin(radians(angl)) > 0 and mass >= 1000 as tilted, case when mass is null and angl is null then null else round(greatest(mass, angl) - 10, 6) end as either from w""")
def expression_values(spark, sf):
    number = F.coalesce("v_double", F.col("v_int").cast("double"))
    rows = table(spark, sf, "attrs_long").where(F.col("key").isin("MASS", "ANGL")).groupBy(*lookup.VERSION).agg(*[F.max(F.when(F.col("key") == k, number)).alias(k) for k in ("MASS", "ANGL")])
    columns = {name: compile_expression(tree_of_payload(encode_words(words)), F.col, options=Options()) for name, words in EXPRESSIONS.items()}
    return rows.select(*lookup.VERSION, *[(F.round(c, 6) if name != "tilted" else c).alias(name) for name, c in columns.items()])


def _printed() -> list[tuple[str, str, str, int]]:
    out = []
    for name, words in EXPRESSIONS.items():
        tree = tree_of_payload(encode_words(words))
        out.append((name, to_text(tree), to_text(tree, "template"), sum(opcode_counts(encode_words(words))[0].values())))
    return out


@query("select * from (values ('load', 'ATTRIB MASS / 2 + SQRT ( ABS ( ATTRIB ANGL ) )', '((MASS/2)+SQRT(ABS(ANGL)))', 7), ('tilted', 'SIN ( ATTRIB ANGL ) GT 0 AND ATTRIB MASS GE 1000', '((SIN(ANGL) GT 0) AND (MASS GE 1000))', 8), ('either', 'MAX ( ATTRIB MASS , ATTRIB ANGL ) - 10', '(MAX(MASS,ANGL)-10)', 5)) t(name, infix, template, n_opcodes)")
def expression_texts(spark, sf):
    return spark.createDataFrame(_printed(), "name string, infix string, template string, n_opcodes int")


# Codecs and names


@query("select distinct dbnum, ref0, ref1, sesno, byte_offset, noun, coalesce(owner_ref0, 0) as owner_ref0, coalesce(owner_ref1, 0) as owner_ref1, coalesce(name, '') as name, coalesce(array_to_string([c.ref0 || '/' || c.ref1 for c in children], ' '), '') as children from element_versions where not deleted and noun is not null")
def record_round_trip(spark, sf):
    """Every version written as a binary record, lists of children in segments of four, and read again."""
    rows = table(spark, sf, "element_versions").where("not deleted and noun is not null").distinct()

    def there_and_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from elemlake.codec.store import Element, read_element, write_element

        for b in batches:
            out = []
            for db, r0, r1, ses, at, noun, o0, o1, name, children in b.itertuples(index=False):
                kids = [] if children is None else [(c["ref0"], c["ref1"]) for c in children]
                x = read_element(write_element(Element((r0, r1), noun, (int(o0), int(o1)), kids, {"NAME": ("string", name or "")}), most_words=13))
                out.append((db, *x.refno, ses, at, x.noun, *x.owner, x.attrs["NAME"][1], " ".join(f"{a}/{b}" for a, b in x.children)))
            yield pd.DataFrame(out, columns=["dbnum", "ref0", "ref1", "sesno", "byte_offset", "noun", "owner_ref0", "owner_ref1", "name", "children"])

    columns = ["dbnum", "ref0", "ref1", "sesno", "byte_offset", "noun", F.coalesce("owner_ref0", F.lit(0)).alias("owner_ref0"), F.coalesce("owner_ref1", F.lit(0)).alias("owner_ref1"), "name", "children"]
    return rows.select(*columns).mapInPandas(there_and_back, "dbnum int, ref0 bigint, ref1 bigint, sesno int, byte_offset bigint, noun string, owner_ref0 bigint, owner_ref1 bigint, name string, children string")


_SET_VALUES = "not (v_int is null and v_double is null and v_bool is null and v_str is null and v_doubles is null and v_refs is null)"


@query(f"""select dbnum, ref0, ref1, sesno, key, max(v_int) as v_int, max(v_double) as v_double, bool_or(v_bool) as v_bool, max(v_str) as v_str, array_to_string(max(v_doubles), ' ') as reals, max(array_to_string([r.ref0 || '/' || r.ref1 for r in v_refs], ' ')) as refs
  from attrs_long where {_SET_VALUES} group by 1, 2, 3, 4, 5""")
def record_attributes(spark, sf):
    """Every attribute of every version in a binary record, a type code for each kind of value, and read again."""
    values = {"v_int": F.max("v_int"), "v_double": F.max("v_double"), "v_bool": F.max("v_bool"), "v_str": F.max("v_str"), "v_doubles": F.max("v_doubles"), "refs": F.max(F.transform("v_refs", lambda r: F.concat_ws("/", r["ref0"], r["ref1"])))}
    cells = table(spark, sf, "attrs_long").where(_SET_VALUES).groupBy(*lookup.VERSION, "key").agg(*[v.alias(n) for n, v in values.items()])
    maps = cells.groupBy(*lookup.VERSION).agg(F.collect_list(F.struct("key", *values)).alias("cells"))  # the attributes of one version, which its noun's layout bounds

    def there_and_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from elemlake.codec.store import Element, read_element, write_element

        # A cell may hold values of several kinds; each goes under a name of its own.
        codes = {"v_int": "I", "v_double": "D", "v_bool": "B", "v_str": "S", "v_doubles": "L", "refs": "R"}
        for b in batches:
            out = []
            for db, r0, r1, ses, cells in b.itertuples(index=False):
                given, names = {}, []
                for i, c in enumerate(cells):
                    names.append(c["key"])
                    for column, code in codes.items():
                        v = c[column]
                        if v is None:
                            continue
                        name = f"{':' if c['key'].startswith(':') else ''}{code}{''.join(chr(65 + int(d)) for d in str(i))}"
                        kind = {"I": "int" if -(1 << 31) <= v < 1 << 31 else "ints"} if code == "I" else {"D": "double", "B": "bool", "S": "string", "L": "doubles", "R": "refs"}
                        value = v if code in "IBDS" else [float(x) for x in v] if code == "L" else [tuple(map(int, x.split("/"))) for x in v]
                        given[name] = (kind[code], [v >> 32, v & 0x7FFFFFFF] if kind[code] == "ints" else value)
                x = read_element(write_element(Element((r0, r1), "ELEM", (0, 0), [], given), most_words=40))
                for i, key in enumerate(names):
                    tail = "".join(chr(65 + int(d)) for d in str(i))
                    found = {code: x.attrs.get(f"{':' if key.startswith(':') else ''}{code}{tail}", (None, None))[1] for code in codes.values()}
                    out.append((db, *x.refno, ses, key, found["I"], found["D"], found["B"], found["S"], found["L"], None if found["R"] is None else " ".join(f"{a}/{c}" for a, c in found["R"])))
            yield pd.DataFrame(out, columns=["dbnum", "ref0", "ref1", "sesno", "key", "v_int", "v_double", "v_bool", "v_str", "v_doubles", "refs"]).astype({"v_int": "Int64", "v_bool": "boolean"})

    back = maps.mapInPandas(there_and_back, "dbnum int, ref0 bigint, ref1 bigint, sesno int, key string, v_int bigint, v_double double, v_bool boolean, v_str string, v_doubles array<double>, refs string")
    return back.select(*lookup.VERSION, "key", "v_int", "v_double", "v_bool", "v_str", F.array_join(F.transform("v_doubles", lambda x: x.cast("string")), " ").alias("reals"), "refs")


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, noun, coalesce(owner_ref0, 0) as owner_ref0, coalesce(owner_ref1, 0) as owner_ref1, coalesce(name, '') as name, coalesce(array_to_string([c.ref0 || '/' || c.ref1 for c in children], ' '), '') as children from standing where not deleted and noun is not null and sesno is not null")
def store_elements(spark, sf):
    """All versions written as binary stores, a commit a session, and read through the index of each session."""
    from elemlake.sources.store import StoreSource, write_stores

    path = new_path(spark, "stores")
    write_stores(table(spark, sf, "element_versions").where("noun is not null"), path)
    spark.dataSource.register(StoreSource)
    rows = spark.read.format("elemlake_store").option("table", "elements").option("errors", "fail").load(f"{path}/*.db")
    return rows.select("dbnum", "ref0", "ref1", "sesno", "noun", "owner_ref0", "owner_ref1", "name", F.array_join(F.transform("children", lambda c: F.concat_ws("/", c["ref0"], c["ref1"])), " ").alias("children"))


@query("select distinct noun, noun_hash, noun as decoded from element_versions where noun_hash is not null")
def noun_names(spark, sf):
    rows = table(spark, sf, "element_versions").where("noun_hash is not null").select("noun", "noun_hash").distinct()
    return rows.select("noun", "noun_hash", name_of_hash(F.col("noun_hash")).alias("decoded"))


@query("select distinct trim(value) as value, cast(regexp_extract(trim(value), '=([0-9]+)/([0-9]+)', 1) as bigint) as ref0, cast(regexp_extract(trim(value), '=([0-9]+)/([0-9]+)', 2) as bigint) as ref1, replace(ltrim(trim(value), '='), '/', '_') as shown from dblist_attrs where regexp_full_match(trim(value), '=[0-9]+/[0-9]+')")
def reference_texts(spark, sf):
    rows = table(spark, sf, "dblist_attrs").select(F.trim("value").alias("value")).where(F.col("value").rlike("^=[0-9]+/[0-9]+$")).distinct().withColumn("r", parse_refno(F.col("value")))
    return rows.select("value", "r.ref0", "r.ref1", refno_text(F.col("r.ref0"), F.col("r.ref1"), "_").alias("shown"))


@query("select noun, attr, attr_type from noun_layout where attr_type = 'Real' and is_expr")
def real_expressions(spark, sf):
    return schema_filter(table(spark, sf, "noun_layout"), "Real", expressions=True).select("noun", "attr", "attr_type")


@query("select distinct noun, attr, attr_type as data_type, attr_hash from noun_layout where attr is not null and noun is not null")
def dictionary_schema(spark, sf):
    """The layout written as a dictionary file, a record and a definition an attribute and an entry a noun's attribute, and read again."""
    from elemlake.sources import dictionary

    codes = {name: code for code, name in dictionary.TYPES.items()}
    layout = table(spark, sf, "noun_layout").select("noun", "attr", "attr_type").where("attr is not null and noun is not null").distinct().orderBy("noun", "attr", "attr_type").collect()
    names = sorted({r["attr"] for r in layout})
    type_of = {r["attr"]: codes[r["attr_type"]] for r in layout}
    found = dictionary.Dictionary(
        [dictionary.Record(i + 1, name, 1, [f"about {name}"]) for i, name in enumerate(["NONE", *names])],
        [(python_name_hash(r["noun"]), names.index(r["attr"]) + 1, codes[r["attr_type"]]) for r in layout],
        [(python_name_hash(name.lstrip(":")), kind, 1, 0) for name, kind in type_of.items()],
    )
    path = new_path(spark, "dictionary")
    write_bytes(spark, f"{path}/one.dat", dictionary.encode_dictionary(found))
    attributes, nouns = dictionary.read_dictionary(spark, path)
    rows = dictionary.noun_schema(attributes, nouns).join(attributes.select(F.col("name").alias("attr"), "attr_hash"), "attr")
    kind = F.element_at(F.create_map(*[x for code, name in dictionary.TYPES.items() for x in (F.lit(code), F.lit(name))]), F.col("type_code"))
    return rows.select("noun", "attr", kind.alias("data_type"), "attr_hash")


@query("select sum(octet_length(encode(text))) as bytes from documents where text <> ''")
def chunk_bytes(spark, sf):
    """Every text cut into content-defined chunks: their lengths add up to the texts'."""
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return chunks.chunk_table(files).agg(F.sum("length").alias("bytes"))


@query("select doc_id, md5(text) as digest from documents where text <> ''")
def chunk_rebuild(spark, sf):
    """Every text put together again: half of them seed a copy, and only the chunks that the seeds lack are fetched from the archive."""
    files = table(spark, sf, "documents").where("text != ''").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    wanted = written(chunks.chunk_table(files), "chunks")
    seeds = chunks.chunk_contents(files.where("cast(path as bigint) % 2 = 0"))
    fetched = chunks.chunk_contents(files).join(chunks.missing_chunks(wanted, seeds), "hash", "left_semi")
    whole = chunks.rebuild(wanted, seeds.unionByName(fetched))
    return whole.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("content").alias("digest"))


@query()
def chunk_saving(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return chunks.saving(written(chunks.chunk_table(files), "chunks"))


# Streams: the whole feed worked off, and its end compared with the batch result


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/changes.parquet"
    return feed.read_feed(spark, path, spark.read.parquet(path).schema)


def _run(stream: DataFrame, sink, name: str, mode: str = "append") -> None:
    """Works the whole stream off into a foreachBatch sink, so that nothing gathers on the driver."""
    checkpoint = new_path(stream.sparkSession, f"stream-{name}")
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(LOOKUP_SQL["daily_operations"])
def stream_daily(spark, sf):
    """Operations by day and kind, from the feed as it arrives: repeated deliveries count once, late ones in full."""
    path = new_path(spark, "daily")
    _run(_feed(spark, sf), feed.keep_operations(path), "daily")
    return feed.kept_daily(spark, path)


@query("select ref0, ref1, max((sesno, op_no))[1] as sesno, max((sesno, op_no))[2] as op_no, count(*) as n from changes where ref0 is not null and ref1 is not null group by 1, 2")
def stream_last_operation(spark, sf):
    """The keyed state of every element after the whole feed."""
    path = new_path(spark, "follow")
    stream = feed.follow_elements(_feed(spark, sf))
    _run(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), "follow", "update")
    last = spark.read.schema(stream.schema).parquet(path).groupBy("ref0", "ref1").agg(F.max(F.struct("n", "last")).alias("x"))
    sesno, op_no = place(F.col("x.last"))
    return last.select("ref0", "ref1", sesno.alias("sesno"), op_no.alias("op_no"), F.col("x.n").alias("n"))


@query("select distinct dbnum, sesno, op_no from changes")
def stream_append_new(spark, sf):
    """The feed appended operation by operation, repeated deliveries ignored."""
    path, keys = new_path(spark, "append"), ["dbnum", "sesno", "op_no"]
    _run(_feed(spark, sf).select(*keys), feed.append_new(path, keys, F.floor(F.col("sesno") / 16).cast("int")), "append")
    return spark.read.parquet(path).select(*keys)
