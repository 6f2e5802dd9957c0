"""Lookup, history, tree and analytics queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.functions.names import name_hash, uda_label
from elemlake.operators import analytics, changes, lookup, persistence, tree
from elemlake.plans.workspace import new_path
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


# Parameters of the queries, the same in Spark and SQL.
SESSION, MOMENT, DAY = 20, "2015-06-30 00:00:00", "2015-08-30"

STANDING = """
standing as (
  select dbnum, ref0, ref1, sesno, byte_offset, coalesce(deleted, false) as deleted, noun, owner_ref0, owner_ref1, name, children from (
    select *, row_number() over (partition by dbnum, ref0, ref1, sesno order by byte_offset desc, deleted desc) as n from element_versions) where n = 1),
ranked as (select *, row_number() over (partition by dbnum, ref0, ref1 order by sesno desc) as k from standing),
now as (select * from ranked where k = 1 and not deleted),
sess as (
  select distinct on (dbnum, sesno) * from sessions where dbnum is not null and sesno is not null
  order by dbnum, sesno, ses_pgno desc, prev_ses_pgno desc, start_pgno desc, end_pgno desc, index_root_pgno desc, claim_pgno desc, ts desc nulls last)
"""
VALID = "valid as (select *, child_pgno * 2048 + offset_words * 2 as address from index_entries where level = 0 and not (ref0 = 0 and ref1 = 0) and not (ref0 = 2147483649 and ref1 = 2147483649) and child_pgno <> 0 and offset_words <> 0)"
OPS = """
ops as (
  select dbnum, ref0, ref1, sesno, op_no, min(case upper(trim(operation_type)) when '新增' then 'add' when 'ADD' then 'add' when '修改' then 'modify' when 'MODIFIED' then 'modify' when '删除' then 'delete' when 'DELETED' then 'delete' else 'none' end) as kind,
    max(entity_type) as entity_type, min(ts) as ts
  from changes group by 1, 2, 3, 4, 5)
"""
KIND_COUNTS = "count(*) filter (kind = 'add') as n_add, count(*) filter (kind = 'modify') as n_modify, count(*) filter (kind = 'delete') as n_delete, count(*) filter (kind = 'none') as n_none"


# Lookups


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, byte_offset, noun, deleted from ranked where k = 1")
def latest_version(spark, sf):
    return lookup.latest(table(spark, sf, "element_versions")).select("dbnum", "ref0", "ref1", "sesno", "byte_offset", "noun", "deleted")


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, byte_offset, noun from now")
def existing_elements(spark, sf):
    return lookup.existing(table(spark, sf, "element_versions")).select("dbnum", "ref0", "ref1", "sesno", "byte_offset", "noun")


@query(f"with {STANDING} select a.dbnum, a.ref0, a.ref1, a.sesno, a.byte_offset, b.sesno as prev_sesno, b.byte_offset as prev_byte_offset from ranked a left join ranked b on b.dbnum = a.dbnum and b.ref0 = a.ref0 and b.ref1 = a.ref1 and b.k = 2 where a.k = 1")
def latest_and_previous(spark, sf):
    return lookup.latest_and_previous(table(spark, sf, "element_versions"))


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, byte_offset, k - 1 as k from ranked")
def version_history(spark, sf):
    return lookup.history(table(spark, sf, "element_versions")).select("dbnum", "ref0", "ref1", "sesno", "byte_offset", "k")


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, case when row_number() over (partition by dbnum, ref0, ref1 order by sesno) = 1 then 'Add' else 'Modified' end as operation from standing qualify sesno < max(sesno) over (partition by dbnum, ref0, ref1)")
def history_operations(spark, sf):
    return lookup.history_labels(table(spark, sf, "element_versions"))


@query(f"with {STANDING}, upto as (select *, row_number() over (partition by dbnum, ref0, ref1 order by sesno desc) as j from standing where sesno <= {SESSION}) select dbnum, ref0, ref1, sesno, noun, name from upto where j = 1 and not deleted")
def as_of_session(spark, sf):
    return lookup.existing(table(spark, sf, "element_versions"), F.col("sesno") <= SESSION).select("dbnum", "ref0", "ref1", "sesno", "noun", "name")


@query(f"with {STANDING}, upto as (select v.*, row_number() over (partition by v.dbnum, v.ref0, v.ref1 order by v.sesno desc) as j from standing v join sess s on s.dbnum = v.dbnum and s.sesno = v.sesno where s.ts <= timestamp '{MOMENT}') select dbnum, ref0, ref1, sesno, noun from upto where j = 1 and not deleted")
def as_of_time(spark, sf):
    return lookup.as_of_time(table(spark, sf, "element_versions"), table(spark, sf, "sessions"), MOMENT).select("dbnum", "ref0", "ref1", "sesno", "noun")


@query(f"with {VALID} select dbnum, ref0, ref1, count(distinct address) as n, min(address) as first_address, max(address) as last_address from valid group by 1, 2, 3")
def index_map(spark, sf):
    found = lookup.index_map(table(spark, sf, "index_entries"))
    return found.select("dbnum", "ref0", "ref1", F.size("addresses").alias("n"), F.element_at("addresses", 1).alias("first_address"), F.element_at("addresses", -1).alias("last_address"))


@query(f"with {VALID}, d as (select distinct dbnum, ref0, ref1, address from valid) select dbnum, ref0, ref1, address from (select *, row_number() over (partition by dbnum, ref0, ref1 order by address desc) as k from d) where k = 2")
def index_second_newest(spark, sf):
    return lookup.index_version(table(spark, sf, "index_entries"), 1)


@query(f"with {STANDING}, ranges as (select dbnum, sesno, coalesce(lag(end_pgno) over (partition by dbnum order by sesno) + 1, 0) as first_pgno, end_pgno from sess) select i.dbnum, i.page_no, i.ord, i.ref0, i.ref1, i.sesno, r.sesno as page_sesno from (select distinct dbnum, page_no, ord, ref0, ref1, sesno from index_entries) i left join ranges r on r.dbnum = i.dbnum and i.page_no between r.first_pgno and r.end_pgno")
def page_session(spark, sf):
    pages = table(spark, sf, "index_entries").select("dbnum", "page_no", "ord", "ref0", "ref1", "sesno").distinct()
    return lookup.session_of_pages(pages, table(spark, sf, "sessions"), "page_no")


@query(f"with {STANDING}, asked as (select distinct dbnum, sesno from changes) select a.dbnum, a.sesno, max(s.sesno) filter (s.sesno < a.sesno) as less_sesno, min(s.sesno) filter (s.sesno >= a.sesno) as large_sesno from asked a left join sess s on s.dbnum = a.dbnum group by 1, 2")
def nearest_sessions(spark, sf):
    return lookup.nearest_sessions(table(spark, sf, "changes"), table(spark, sf, "sessions"))


@query(f"with {STANDING}, edges as (select dbnum, ref0, ref1, unnest(children) as c, generate_subscripts(children, 1) - 1 as ord from now) select e.dbnum, e.ref0, e.ref1, e.c.ref0 as child_ref0, e.c.ref1 as child_ref1, e.ord from edges e where exists (select 1 from now n where n.dbnum = e.dbnum and n.ref0 = e.c.ref0 and n.ref1 = e.c.ref1)")
def known_children(spark, sf):
    return lookup.known_children(table(spark, sf, "element_versions"))


@query(f"with {STANDING} select n.dbnum, n.ref0, n.ref1, n.owner_ref0, n.owner_ref1 from now n join now o on o.dbnum = n.dbnum and o.ref0 = n.owner_ref0 and o.ref1 = n.owner_ref1 where not list_contains(coalesce(o.children, []), {{'ref0': n.ref0, 'ref1': n.ref1}})")
def not_listed_by_owner(spark, sf):
    return lookup.not_listed_by_owner(table(spark, sf, "element_versions"))


@query(f"""with {STANDING}, {VALID}, i as (select dbnum, ref0, ref1, max(sesno) as v from valid group by 1, 2, 3), e as (select dbnum, ref0, ref1, max(sesno) as v from standing group by 1, 2, 3),
  o as (select coalesce(i.dbnum, e.dbnum) as dbnum, case when e.dbnum is null then 'left_only' when i.dbnum is null then 'right_only' when i.v = e.v then 'matched' else 'mismatched' end as outcome from i full join e on i.dbnum = e.dbnum and i.ref0 = e.ref0 and i.ref1 = e.ref1)
  select dbnum, outcome, count(*) as n from o group by 1, 2""")
def reconcile_index(spark, sf):
    left = lookup.valid_entries(table(spark, sf, "index_entries")).groupBy(*lookup.ELEMENT).agg(F.max("sesno").alias("v"))
    right = table(spark, sf, "element_versions").groupBy(*lookup.ELEMENT).agg(F.max("sesno").alias("v"))
    return lookup.reconcile(left, right, lookup.ELEMENT, "v").groupBy("dbnum", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("with d as (select distinct dbnum, byte_offset from element_versions where byte_offset is not null) select dbnum, byte_offset, lead(byte_offset) over (partition by dbnum order by byte_offset) as next_offset from d")
def record_ends(spark, sf):
    return lookup.record_lengths(table(spark, sf, "element_versions"))


@query("select dbnum, count(distinct ref0) as n_ref0 from element_versions group by 1")
def distinct_high_words(spark, sf):
    return table(spark, sf, "element_versions").groupBy("dbnum").agg(F.countDistinct("ref0").alias("n_ref0"))


@query("select ref0, ref1 from element_versions intersect select ref0, ref1 from index_entries where level = 0")
def in_both_stores(spark, sf):
    return table(spark, sf, "element_versions").select("ref0", "ref1").intersect(table(spark, sf, "index_entries").where("level = 0").select("ref0", "ref1"))


@query("select dbnum, ref0, ref1, sesno from element_versions except select dbnum, ref0, ref1, sesno from index_entries where level = 0")
def scan_only(spark, sf):
    """Versions that the index of their session does not name."""
    key = ["dbnum", "ref0", "ref1", "sesno"]
    return table(spark, sf, "element_versions").select(*key).subtract(table(spark, sf, "index_entries").where("level = 0").select(*key))


@query("select ref0, ref1 from index_entries where level = 0 except select ref0, ref1 from element_versions")
def index_only(spark, sf):
    return table(spark, sf, "index_entries").where("level = 0").select("ref0", "ref1").subtract(table(spark, sf, "element_versions").select("ref0", "ref1"))


@query("select noun, attr, attr_hash, true as agrees from noun_layout")
def layout_hashes(spark, sf):
    rows = table(spark, sf, "noun_layout")
    return rows.select("noun", "attr", "attr_hash", (name_hash(F.col("attr")) == F.col("attr_hash")).alias("agrees"))


@query("select distinct key, 'UDA_' || ltrim(key, ':') as label from attrs_long where kind = 'uda'")
def uda_labels(spark, sf):
    return table(spark, sf, "attrs_long").where("kind = 'uda'").select("key").distinct().select("key", uda_label(F.col("key")).alias("label"))


# Change capture


@query(f"with {STANDING}, ranges as (select dbnum, sesno, lag(end_pgno) over (partition by dbnum order by sesno) as after, end_pgno from sess) select distinct i.dbnum, i.ref0, i.ref1, i.sesno from index_entries i join ranges r on r.dbnum = i.dbnum and r.sesno = i.sesno where i.flag = 1 and i.child_pgno > r.after and i.child_pgno < r.end_pgno")
def session_touched(spark, sf):
    return changes.touched_entries(table(spark, sf, "index_entries"), table(spark, sf, "sessions"))


@query(f"with {STANDING}, ranges as (select dbnum, sesno, lag(end_pgno) over (partition by dbnum order by sesno) as after, end_pgno from sess), touched as (select distinct i.dbnum, i.ref0, i.ref1, i.sesno from index_entries i join ranges r on r.dbnum = i.dbnum and r.sesno = i.sesno where i.flag = 1 and i.child_pgno > r.after and i.child_pgno < r.end_pgno) select dbnum, ref0, ref1, sesno, byte_offset, noun, deleted from standing semi join touched using (dbnum, ref0, ref1, sesno)")
def session_elements(spark, sf):
    """The versions that the index says their session touched."""
    rows = changes.touched_versions(table(spark, sf, "element_versions"), table(spark, sf, "index_entries"), table(spark, sf, "sessions"))
    return rows.select("dbnum", "ref0", "ref1", "sesno", "byte_offset", "noun", "deleted")


VALUE = "case when v_int is not null then 'n' || (cast(cast(v_int as double) as float) + 0::float)::varchar when v_double is not null then 'n' || (cast(v_double as float) + 0::float)::varchar when v_bool is not null then 'b' || v_bool::varchar when v_str is not null then 's' || v_str when v_doubles is not null then '[' || array_to_string([(cast(x as float) + 0::float)::varchar for x in v_doubles], ',') || ']' when v_refs is not null then 'r' || v_refs::varchar end"
DELTAS = f"""
vals as (select dbnum, ref0, ref1, sesno, kind, key, max({VALUE}) as v from attrs_long group by 1, 2, 3, 4, 5, 6 having max({VALUE}) is not null),
steps as (select dbnum, ref0, ref1, sesno, lag(sesno) over (partition by dbnum, ref0, ref1 order by sesno) as prev from standing where not deleted),
deltas as (
  select s.dbnum, s.ref0, s.ref1, s.sesno, n.kind, n.key, case when o.key is null then 'added' else 'modified' end as change
  from steps s join vals n on n.dbnum = s.dbnum and n.ref0 = s.ref0 and n.ref1 = s.ref1 and n.sesno = s.sesno
    left join vals o on o.dbnum = s.dbnum and o.ref0 = s.ref0 and o.ref1 = s.ref1 and o.sesno = s.prev and o.kind = n.kind and o.key = n.key
  where s.prev is not null and (o.key is null or o.v <> n.v)
  union all
  select s.dbnum, s.ref0, s.ref1, s.sesno, o.kind, o.key, 'deleted'
  from steps s join vals o on o.dbnum = s.dbnum and o.ref0 = s.ref0 and o.ref1 = s.ref1 and o.sesno = s.prev
    left join vals n on n.dbnum = s.dbnum and n.ref0 = s.ref0 and n.ref1 = s.ref1 and n.sesno = s.sesno and o.kind = n.kind and o.key = n.key
  where n.key is null)
"""


@query(f"with {STANDING}, {DELTAS} select dbnum, ref0, ref1, sesno, kind, key, change from deltas")
def attribute_deltas(spark, sf):
    return changes.attribute_deltas(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"))


PAIRS = "pairs as (select *, lag(deleted) over w as p_deleted, lag(noun) over w as p_noun, lag(name) over w as p_name, lag(owner_ref0) over w as p_owner0, lag(owner_ref1) over w as p_owner1, lag(children) over w as p_children from standing window w as (partition by dbnum, ref0, ref1 order by sesno))"
COUNTS = f"""{STANDING}, {DELTAS}, {PAIRS},
keys as (
  select kind || ':' || ltrim(key, ':') as change_key from deltas
  union all select 'meta:name' from pairs where not deleted and not p_deleted and name is distinct from p_name
  union all select 'meta:noun' from pairs where not deleted and not p_deleted and noun is distinct from p_noun
  union all select 'meta:owner' from pairs where not deleted and not p_deleted and (owner_ref0 is distinct from p_owner0 or owner_ref1 is distinct from p_owner1)
  union all select 'meta:children' from pairs where not deleted and not p_deleted and coalesce(children, []) <> coalesce(p_children, [])),
counts as (select change_key, count(*) as n from keys group by 1)"""


@query(f"with {COUNTS} select * from counts")
def change_counts(spark, sf):
    return changes.change_counts(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"))


@query(f"with {COUNTS} select * from counts order by n desc, change_key limit 10")
def change_counts_top(spark, sf):
    return changes.top_changes(change_counts(spark, sf), 10)


def _status_sql(owner: str = "now o on o.dbnum = p.dbnum and o.ref0 = p.owner_ref0 and o.ref1 = p.owner_ref1", exists: str = "o.dbnum is not null") -> str:
    child_sets = "list_sort(list_distinct(coalesce(p.children, []))) <> list_sort(list_distinct(coalesce(p.p_children, [])))"
    return f"""{STANDING}, {DELTAS.replace("from attrs_long group by", "from attrs_long where key not in ('PGNO', 'SESNO') group by")}, {PAIRS},
nd as (select dbnum, ref0, ref1, sesno, count(*) as n from deltas group by 1, 2, 3, 4),
ruled as (
  select p.*, coalesce(nd.n, 0) as n_attributes, {child_sets} as children_changed,
    case when p.deleted then 'removed' when p.p_deleted is null or p.p_deleted then 'first'
      when not (p.owner_ref0 is null or p.owner_ref1 is null or (p.owner_ref0 = 0 and p.owner_ref1 = 0)) and (case when not ({exists}) then coalesce(p.noun <> 'SITE', true) else not list_contains(coalesce(o.children, []), {{'ref0': p.ref0, 'ref1': p.ref1}}) end) then 'lost'
      when {child_sets} or p.noun is distinct from p.p_noun or p.name is distinct from p.p_name or p.owner_ref0 is distinct from p.p_owner0 or p.owner_ref1 is distinct from p.p_owner1 or nd.n is not null then 'differs' else 'same' end as rule
  from pairs p left join {owner}
    left join nd on nd.dbnum = p.dbnum and nd.ref0 = p.ref0 and nd.ref1 = p.ref1 and nd.sesno = p.sesno),
own as (
  select dbnum, ref0, ref1, sesno, case rule when 'first' then 'Add' when 'differs' then 'Modified' else 'Deleted' end as operation, rule = 'differs' and children_changed as children_changed, case when rule = 'differs' then n_attributes else 0 end as n_attributes, sesno as by_sesno, dbnum as by_dbnum, ref0 as by_ref0, ref1 as by_ref1
  from ruled where rule <> 'same'),
dropped as (
  select dbnum, c.ref0 as ref0, c.ref1 as ref1, sesno, ref0 as by_ref0, ref1 as by_ref1 from (select dbnum, sesno, ref0, ref1, unnest(list_filter(p_children, lambda x: not list_contains(coalesce(children, []), x))) as c from ruled where rule in ('differs', 'same') and p_children is not null)
  where c.ref0 is not null and c.ref1 is not null),
status as (
  select dbnum, ref0, ref1, sesno, operation, children_changed, n_attributes from own
  union all
  select distinct dbnum, ref0, ref1, sesno, 'Deleted', false, 0 from dropped d where not exists (select 1 from own o where o.dbnum = d.dbnum and o.ref0 = d.ref0 and o.ref1 = d.ref1 and o.sesno = d.sesno))"""


STATUS = _status_sql()
STATUS_THEN = _status_sql("(select k.dbnum, k.k0, k.k1, k.s, v.children, v.deleted from (select distinct dbnum, owner_ref0 as k0, owner_ref1 as k1, sesno as s from standing) k asof join standing v on v.dbnum = k.dbnum and v.ref0 = k.k0 and v.ref1 = k.k1 and k.s >= v.sesno) o on o.dbnum = p.dbnum and o.k0 = p.owner_ref0 and o.k1 = p.owner_ref1 and o.s = p.sesno", "o.dbnum is not null and not o.deleted")


@query(f"with {STATUS} select * from status")
def operation_status(spark, sf):
    return changes.operation_status(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"))


@query(f"with {STATUS_THEN} select * from status")
def operation_status_then(spark, sf):
    """The owner as it was in the session of the version."""
    return changes.operation_status(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"), "session")


@query(f"with {STATUS} select dbnum, sesno, operation, count(*) as n from status where sesno between 5 and {SESSION} group by 1, 2, 3")
def increments_by_session(spark, sf):
    rows = changes.increments(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"), first=5, last=SESSION)
    return rows.groupBy("dbnum", "sesno", "operation").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {STATUS}, recent as (select dbnum, sesno from (select dbnum, sesno, row_number() over (partition by dbnum order by sesno desc) as k from sess) where k <= 3) select s.dbnum, s.ref0, s.ref1, s.sesno, s.operation from status s join recent using (dbnum, sesno)")
def recent_increments(spark, sf):
    recent = changes.recent_sessions(table(spark, sf, "sessions"), 3)
    return changes.increments(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"), recent).select("dbnum", "ref0", "ref1", "sesno", "operation")


@query(f"""with {STATUS}, newest as (select dbnum, ref0, ref1, max(sesno) as sesno from standing group by 1, 2, 3),
  o as (select own.dbnum, own.ref0, own.ref1, own.sesno, operation from own semi join newest using (dbnum, ref0, ref1, sesno) where sesno between 5 and {SESSION}),
  d as (select distinct d.dbnum, d.ref0, d.ref1, d.sesno, 'Deleted' as operation from dropped d join newest n on n.dbnum = d.dbnum and n.ref0 = d.by_ref0 and n.ref1 = d.by_ref1 and n.sesno = d.sesno where d.sesno between 5 and {SESSION})
  select * from o union all select * from d anti join o using (dbnum, ref0, ref1, sesno)""")
def increments_at_newest(spark, sf):
    """What a range of sessions did, as far as it is the last word on an element."""
    rows = changes.increments(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"), first=5, last=SESSION, only_latest=True)
    return rows.select("dbnum", "ref0", "ref1", "sesno", "operation")


@query(f"with {STATUS} select dbnum, ref0, ref1, sesno, operation from (select *, row_number() over (partition by dbnum, ref0, ref1 order by sesno desc) as k from status) where k = 1 and operation <> 'Deleted'")
def latest_state(spark, sf):
    return changes.latest_state(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long"))


@query(f"with {STANDING} select dbnum, ref0, ref1, case when bool_or(k = 1 and deleted) then 'Deleted' when count(*) = 1 then 'Add' else 'Modified' end as operation from ranked group by 1, 2, 3")
def version_status(spark, sf):
    return changes.version_status(table(spark, sf, "element_versions"))


@query(f"""with {STANDING},
  prev as (select dbnum, ref0, ref1, arg_max(struct_pack(o0 := owner_ref0, o1 := owner_ref1), sesno) as p from ranked where k > 1 and not deleted group by 1, 2, 3),
  last as (select r.*, p is not null as has_prev, p.o0 as p0, p.o1 as p1 from ranked r left join prev using (dbnum, ref0, ref1) where k = 1),
  judged as (
    select l.*, o.ref0 is not null as has_owner, list_contains(coalesce(o.children, []), struct_pack(ref0 := l.ref0, ref1 := l.ref1)) as in_list,
      o.ref0 is not null and len(list_filter(coalesce(b.children, []), lambda c: not list_contains(coalesce(o.children, []), c))) > 0 as lost
    from last l left join now o on o.dbnum = l.dbnum and o.ref0 = l.owner_ref0 and o.ref1 = l.owner_ref1 left join now b on b.dbnum = l.dbnum and b.ref0 = l.p0 and b.ref1 = l.p1)
  select dbnum, ref0, ref1, case when deleted then 'Deleted' when not has_prev then 'Add'
    when not (owner_ref0 is null or owner_ref1 is null or (owner_ref0 = 0 and owner_ref1 = 0)) and case when has_owner then not in_list else noun is distinct from 'SITE' end then 'Deleted'
    when lost then 'Deleted' else 'Modified' end as operation from judged""")
def primary_status(spark, sf):
    return changes.primary_status(table(spark, sf, "element_versions"))


@query(f"with {STANDING}, {PAIRS}, gone as (select dbnum, sesno, ref0, ref1, unnest(p_children) as c, children from pairs where not deleted and not p_deleted) select distinct dbnum, sesno, ref0, ref1, c.ref0 as child_ref0, c.ref1 as child_ref1 from gone where not list_contains(coalesce(children, []), c)")
def dropped_children(spark, sf):
    return changes.dropped_children(table(spark, sf, "element_versions"))


@query(f"""with {STANDING}, vals as (select dbnum, ref0, ref1, sesno, kind, key, max({VALUE}) as v from attrs_long where key not in ('PGNO', 'SESNO') group by 1, 2, 3, 4, 5, 6 having max({VALUE}) is not null),
  maps as (select dbnum, ref0, ref1, sesno, string_agg(kind || chr(1) || key || chr(1) || v, chr(2) order by kind, key) as m from vals group by 1, 2, 3, 4),
  rows as (select s.*, concat_ws(chr(3), coalesce(noun, chr(4)), coalesce(owner_ref0::varchar, chr(4)), coalesce(owner_ref1::varchar, chr(4)), coalesce(name, chr(4)), coalesce(children, [])::varchar, coalesce(m, chr(4))) as c from standing s left join maps using (dbnum, ref0, ref1, sesno)),
  marked as (select *, lag(case when not deleted then c end) over (partition by dbnum, ref0, ref1 order by sesno) as b from rows)
  select dbnum, ref0, ref1, sesno from marked where deleted or b is null or c <> b""")
def versions_without_repeats(spark, sf):
    return changes.without_repeats(table(spark, sf, "element_versions"), table(spark, sf, "attrs_long")).select("dbnum", "ref0", "ref1", "sesno")


# What is kept between runs


@query(f"with {STATUS}, n as (select dbnum, sesno, count(*) filter (operation = 'Add') as add_count, count(*) filter (operation = 'Modified') as modify_count, count(*) filter (operation = 'Deleted') as delete_count from status group by 1, 2) select s.dbnum, s.sesno, s.computer_name, s.end_pgno, coalesce(n.add_count, 0)::int as add_count, coalesce(n.modify_count, 0)::int as modify_count, coalesce(n.delete_count, 0)::int as delete_count from sess s left join n using (dbnum, sesno)")
def session_statistics(spark, sf):
    rows = persistence.session_statistics(table(spark, sf, "sessions"), operation_status(spark, sf))
    return rows.select("dbnum", "sesno", "computer_name", "end_pgno", "add_count", "modify_count", "delete_count")


@query(f"with {STATUS} select dbnum, ref0, ref1, sesno, noun, name from standing semi join (select * from status where operation = 'Add') using (dbnum, ref0, ref1, sesno)")
def added_elements(spark, sf):
    return persistence.added_elements(operation_status(spark, sf), table(spark, sf, "element_versions")).select("dbnum", "ref0", "ref1", "sesno", "noun", "name")


@query(f"""with {STANDING} select dbnum, sesno, '{{"id":"' || dbnum || '_' || sesno || '","sesno":' || sesno || ',"pgno":' || coalesce(ses_pgno, 0) || ',"dbnum":' || dbnum || ',"index_pgno":' || coalesce(index_root_pgno, 0) || ',"claim_pgno":' || coalesce(claim_pgno, 0) || ',"end_pgno":' || coalesce(end_pgno, 0)
  || ',"computer_name":' || to_json(coalesce(computer_name, '')) || ',"comments":' || to_json(coalesce(comments, '')) || ',"date":"' || coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00'), '') || '"}}' as json from sess""")
def session_json(spark, sf):
    return persistence.session_json(table(spark, sf, "sessions"))


@query(f"with {STANDING} select dbnum, ref0, ref1, sesno, noun, name from ranked where k > 1 and not deleted and noun is not null")
def noun_history(spark, sf):
    """Older versions in a table with a folder per noun, saved twice."""
    path = new_path(spark, "history")
    for _ in range(2):
        persistence.save_noun_history(table(spark, sf, "element_versions").where("noun is not null"), path)
    return spark.read.parquet(path).select("dbnum", "ref0", "ref1", "sesno", F.col("noun").cast("string").alias("noun"), "name")


@query(f"with {STANDING}, keep as (select dbnum, ref0, ref1 from now where noun in ('WORL', 'SITE', 'ZONE', 'BRAN')), kids as (select dbnum, ref0, ref1, unnest(children) as c, generate_subscripts(children, 1) as ord from now semi join keep using (dbnum, ref0, ref1)), kept as (select k.dbnum, k.ref0, k.ref1, string_agg(c.ref0 || '/' || c.ref1, ' ' order by ord) as kids from kids k join keep on keep.dbnum = k.dbnum and keep.ref0 = k.c.ref0 and keep.ref1 = k.c.ref1 group by 1, 2, 3) select n.dbnum, n.ref0, n.ref1, n.noun, coalesce(kids, '') as children from now n semi join keep using (dbnum, ref0, ref1) left join kept using (dbnum, ref0, ref1)")
def element_subset(spark, sf):
    """The elements of a list, with the children that are in it."""
    versions = table(spark, sf, "element_versions")
    rows = persistence.subset(versions, lookup.existing(versions).where("noun in ('SITE', 'ZONE', 'BRAN')"))
    return rows.select("dbnum", "ref0", "ref1", "noun", F.array_join(F.transform("children", lambda c: F.concat_ws("/", c["ref0"], c["ref1"])), " ").alias("children"))


@query("select distinct noun, dbnum, ref0, ref1 from element_versions where noun is not null")
def noun_members(spark, sf):
    return persistence.noun_members(table(spark, sf, "element_versions"))


@query("select distinct dbnum, ref0, ref1, sesno, byte_offset, name from element_versions where name is not null order by name, dbnum, ref0, ref1, sesno, byte_offset limit 100")
def first_named(spark, sf):
    rows = table(spark, sf, "element_versions").select("dbnum", "ref0", "ref1", "sesno", "byte_offset", "name").distinct()
    return persistence.first_filled(rows, "name", ["name", "dbnum", "ref0", "ref1", "sesno", "byte_offset"], 100)


# Analytics over the change log


@query(f"with {OPS} select cast(ts as date) as day, count(*) as n from ops where ts is not null group by 1")
def daily_counts(spark, sf):
    return analytics.daily_counts(table(spark, sf, "changes"))


@query(f"with {OPS} select cast(ts as date) as day, {KIND_COUNTS} from ops where ts is not null group by 1")
def daily_operations(spark, sf):
    return analytics.daily_operations(table(spark, sf, "changes"))


def _overview_sql() -> str:
    days = (("today", f"cast(ts as date) = date '{DAY}'"), ("yesterday", f"cast(ts as date) = date '{DAY}' - 1"))
    counts = ", ".join(f"count(*) filter ({when} and kind = '{k}') as {name}_{k}" for name, when in days for k in analytics.KINDS)
    return f"with {OPS} select {counts}, count(distinct (dbnum, ref0, ref1)) as n_elements from ops"


@query(_overview_sql())
def day_overview(spark, sf):
    return analytics.overview(table(spark, sf, "changes"), DAY)


@query(f"with {OPS} select * from ops where ts >= timestamp '2015-01-01' and ts < timestamp '2015-01-01' + interval 300 days order by ts desc, dbnum, sesno, op_no limit 50 offset 20")
def change_page(spark, sf):
    return analytics.day_page(table(spark, sf, "changes"), "2015-01-01", 300, 50, 20)


@query(f"with {OPS} select dbnum, sesno, {KIND_COUNTS} from ops group by 1, 2")
def operations_by_session(spark, sf):
    return analytics.operations_by_session(table(spark, sf, "changes"))


@query(f"with {STANDING}, {OPS} select coalesce(s.computer_name, '') as computer, o.kind, count(*) as n from ops o left join sess s using (dbnum, sesno) group by 1, 2")
def operations_by_computer(spark, sf):
    rows = analytics.with_sessions(table(spark, sf, "changes"), table(spark, sf, "sessions"))
    return rows.groupBy(F.coalesce("computer_name", F.lit("")).alias("computer"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {OPS}, e as (select dbnum, ref0, ref1, count(*) as n, {KIND_COUNTS} from ops group by 1, 2, 3),
  g as (select dbnum, sum(n_add) as n_add, sum(n_modify) as n_modify, sum(n_delete) as n_delete, sum(n_none) as n_none, count(*) as n_elements, count(*) filter (n > 1) as n_repeated from e group by 1),
  c as (select dbnum, count(distinct sesno) as n_covered from changes group by 1), s as (select dbnum, count(distinct sesno) as n_sessions from sessions group by 1)
  select s.dbnum, n_sessions, coalesce(n_covered, 0) as n_covered, coalesce(n_add, 0)::bigint as n_add, coalesce(n_modify, 0)::bigint as n_modify, coalesce(n_delete, 0)::bigint as n_delete, coalesce(n_none, 0)::bigint as n_none, coalesce(n_elements, 0) as n_elements, coalesce(n_repeated, 0) as n_repeated
  from s left join c using (dbnum) left join g using (dbnum)""")
def coverage(spark, sf):
    return analytics.coverage(table(spark, sf, "changes"), table(spark, sf, "sessions"))


@query("select attr_type, count(*) as n, count(*) filter (is_expr) as n_expressions from noun_layout group by 1")
def type_histogram(spark, sf):
    return analytics.type_histogram(table(spark, sf, "noun_layout"))


@query("select noun, string_agg(distinct attr, ',' order by attr) as attrs from noun_layout group by 1")
def noun_attributes(spark, sf):
    return analytics.noun_attributes(table(spark, sf, "noun_layout")).select("noun", F.array_join("attrs", ",").alias("attrs"))


@query("select dbnum, noun, count(distinct (ref0, ref1)) as n_elements from element_versions group by 1, 2")
def noun_elements(spark, sf):
    return analytics.noun_elements(table(spark, sf, "element_versions"))


@query("select key, count(*) as n, count(*) filter (v_int is null and v_double is null and v_bool is null and v_str is null and v_ints is null and v_doubles is null and v_strs is null and v_refs is null) as n_unset, string_agg(distinct tag, ',' order by tag) as tags, string_agg(distinct kind, ',' order by kind) as kinds from attrs_long group by 1")
def attribute_profile(spark, sf):
    return analytics.attribute_profile(table(spark, sf, "attrs_long"))


@query("select dbnum, count(sesno) as n, min(sesno) in (0, 1) and max(sesno) - min(sesno) + 1 = count(distinct sesno) and count(distinct sesno) = count(sesno) as contiguous from (select distinct dbnum, sesno from sessions) group by 1")
def session_contiguity(spark, sf):
    return analytics.contiguity(table(spark, sf, "sessions").select("dbnum", "sesno").distinct(), ["dbnum"], "sesno")


@query(f"with {STANDING} select dbnum, count(*) as n_sessions, max(sesno) as last_sesno, arg_max(ts, sesno) as last_ts, cast(epoch(arg_max(ts, sesno)) as bigint) as last_unix, max(end_pgno) as max_pgno from sess group by 1")
def session_summary(spark, sf):
    return analytics.session_summary(lookup.sessions_once(table(spark, sf, "sessions")))


@query("select distinct dbnum, sesno, ts from sessions where ts between timestamp '2014-01-01' and timestamp '2015-12-31' order by ts, dbnum, sesno")
def sessions_between(spark, sf):
    return analytics.sessions_between(table(spark, sf, "sessions"), "2014-01-01", "2015-12-31")


@query("select distinct dbnum, sesno, unnest([x for x in [case when sesno is null or sesno <= 0 then 'sesno' end, case when end_pgno is null or end_pgno <= 0 or end_pgno < ses_pgno then 'pages' end, case when prev_ses_pgno >= ses_pgno then 'chain' end, case when index_root_pgno is null or index_root_pgno <= 0 then 'index' end] if x is not null]) as rule from sessions")
def session_violations(spark, sf):
    return analytics.session_violations(table(spark, sf, "sessions"))


# Trees


EDGES = "edges as (select distinct e.dbnum, e.ref0 as parent0, e.ref1 as parent1, e.c.ref0 as ref0, e.c.ref1 as ref1 from (select dbnum, ref0, ref1, unnest(children) as c from now) e where exists (select 1 from now n where n.dbnum = e.dbnum and n.ref0 = e.c.ref0 and n.ref1 = e.c.ref1))"


@query(f"with recursive {STANDING}, {EDGES}, down as (select dbnum, ref0, ref1, 0 as depth from now where noun = 'WORL' union select e.dbnum, e.ref0, e.ref1, d.depth + 1 from down d join edges e on e.dbnum = d.dbnum and e.parent0 = d.ref0 and e.parent1 = d.ref1 where d.depth < 400) select dbnum, ref0, ref1, min(depth) as depth from down group by 1, 2, 3")
def below_worlds(spark, sf):
    return tree.below_worlds(table(spark, sf, "element_versions"))


@query(f"with recursive {STANDING}, {EDGES}, down as (select dbnum, ref0, ref1, 0 as depth from now where noun = 'SITE' union select e.dbnum, e.ref0, e.ref1, d.depth + 1 from down d join edges e on e.dbnum = d.dbnum and e.parent0 = d.ref0 and e.parent1 = d.ref1 where d.depth < 2) select dbnum, ref0, ref1, min(depth) as depth from down group by 1, 2, 3")
def below_sites_two_levels(spark, sf):
    versions = table(spark, sf, "element_versions")
    return tree.descend(lookup.existing(versions).where("noun = 'SITE'"), tree.child_edges(versions), 2)


@query(f"with {STANDING}, l as (select dbnum, ref0 as parent0, ref1 as parent1, unnest(children) as c, generate_subscripts(children, 1) - 1 as ord, len(children) as n, children from now) select dbnum, parent0, parent1, c.ref0 as ref0, c.ref1 as ref1, ord, case when ord > 0 then children[ord].ref1 end as prev_ref1, children[ord + 2].ref1 as next_ref1, ord = 0 as is_first, ord = n - 1 as is_last from l")
def siblings(spark, sf):
    return tree.siblings(table(spark, sf, "element_versions"))


@query(f"with {STANDING} select dbnum, ref0, ref1, coalesce(len(children), 0) as n_listed, coalesce(len(list_distinct(children)), 0) as n_distinct from now")
def child_counts(spark, sf):
    return tree.child_counts(table(spark, sf, "element_versions"))


@query(f"""with {STANDING}, own as (select v.dbnum, v.ref0, v.ref1, v.sesno, s.ts from standing v left join sess s on s.dbnum = v.dbnum and s.sesno = v.sesno),
  newest as (select dbnum, ref0, ref1, max(sesno) as newest from own group by 1, 2, 3),
  found as (select o.dbnum, o.ref0, o.ref1, max(o.sesno) filter (o.ts <= m.ts) as sesno from own o left join sess m on m.dbnum = o.dbnum and m.sesno = {SESSION} group by 1, 2, 3)
  select dbnum, ref0, ref1, sesno, coalesce(sesno = newest, false) as is_latest from found join newest using (dbnum, ref0, ref1)""")
def resolve_as_of(spark, sf):
    versions = table(spark, sf, "element_versions")
    asked = versions.select(*lookup.ELEMENT, F.lit(SESSION).alias("s"), F.col("dbnum").alias("s_db")).distinct()
    return lookup.resolve_versions(asked, versions, table(spark, sf, "sessions")).drop("s", "s_db")


@query(f"with {VALID}, d as (select distinct dbnum, child_pgno, offset_words from valid) select *, coalesce(lead(offset_words) over (partition by dbnum, child_pgno order by offset_words), 1024) - offset_words as length from d")
def record_slots(spark, sf):
    rows = lookup.valid_entries(table(spark, sf, "index_entries")).select("dbnum", "child_pgno", "offset_words").distinct()
    return lookup.slot_lengths(rows.withColumn("total", F.lit(1024)), ["dbnum", "child_pgno"], "offset_words", "total").drop("total")
