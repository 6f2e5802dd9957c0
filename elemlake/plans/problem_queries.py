"""The queries of the data-pipeline operators over element tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elemlake.operators.attribute_pivot import long_form, unfilled_cells, wide_table
from elemlake.operators.change_feed import current_attributes
from elemlake.operators.hierarchy import element_hierarchy, hierarchy, parent_links, subtree_sums, words
from elemlake.operators.references import orphan_references, orphan_report
from elemlake.operators.satellites import attributes_as_of, element_periods, satellite_periods, satellites
from elemlake.operators.snapshot_diff import snapshot_changes
from elemlake.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return unfilled_cells(table(spark, sf, "dblist_attrs"), table(spark, sf, "noun_layout"))


def p1_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide_table(table(spark, sf, "dblist_attrs"), table(spark, sf, "noun_layout"))


def p1_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table's filled cells, a row each, so that SQL can compare every typed column."""
    return long_form(p1_wide(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "element_snapshots")).select("dbnum", "ses_no", "ref0", "ref1", "diff_type", "attr")


def p2_summary(spark: SparkSession, sf: str) -> DataFrame:
    changes = snapshot_changes(table(spark, sf, "element_snapshots"))
    return changes.groupBy("dbnum", "ses_no", "diff_type").agg(F.countDistinct("ref0", "ref1").alias("n_elements"), F.count(F.lit(1)).alias("n_rows"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    stored = satellites(table(spark, sf, "attrs_long"), table(spark, sf, "element_versions"))
    return element_periods(stored).select("ref0", "ref1", "from_sesno", "to_sesno").distinct()


def p3_satellites(spark: SparkSession, sf: str) -> DataFrame:
    stored = satellites(table(spark, sf, "attrs_long"), table(spark, sf, "element_versions"))
    return satellite_periods(stored).groupBy("dbnum", "satellite").agg(F.count(F.lit(1)).alias("n_periods"), F.count_if(F.col("to_sesno") == 0).alias("n_open"))


def p3_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Every attribute of every element after session 20, read from the satellites; numbers as the 32-bit reals they are compared by, booleans and texts as they are."""
    rows = attributes_as_of(satellites(table(spark, sf, "attrs_long"), table(spark, sf, "element_versions")), 20)
    real = F.col("value").try_cast("double").cast("float").cast("double")
    text = F.when(F.col("value").startswith('"'), F.variant_get(F.try_parse_json("value"), "$", "string")).when(F.col("value").isin("true", "false"), F.col("value"))
    return rows.select("dbnum", "ref0", "ref1", "key", real.alias("number"), text.alias("text"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return current_attributes(table(spark, sf, "changes")).select("ref0", "ref1", "attr", "sesno", "op_no")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(table(spark, sf, "element_versions"), table(spark, sf, "index_entries"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return element_hierarchy(table(spark, sf, "element_versions")).select("ref0", "ref1", "root_ref0", "root_ref1", "depth")


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    return element_hierarchy(table(spark, sf, "element_versions"), paths=True).select("ref0", "ref1", "depth", "n_descendants", "path")


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants of an element are those of its root whose preorder lies in (preorder, last_descendant]; siblings may come in any order, so there is no SQL for the numbers."""
    return element_hierarchy(table(spark, sf, "element_versions")).select("ref0", "ref1", "root_ref0", "root_ref1", "preorder", "last_descendant")


def p6_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of ref1 over every element and its descendants, from the preorder intervals: which elements they hold, told by a number that SQL can find."""
    tree = hierarchy(parent_links(table(spark, sf, "element_versions"))).withColumn("amount", words("id")[1])
    ref0, ref1 = words("id")
    return subtree_sums(tree, "amount").select(ref0.alias("ref0"), ref1.alias("ref1"), "total")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_wide, p1_cells, p2_found, p2_summary, p3_found, p3_satellites, p3_as_of, p4_found, p5_found, p5_report, p6_found, p6_paths, p6_descendants, p6_subtrees)
}

_P1_LINES = r"""
lines as (
  select source, elem_no, upper(trim(key)) as attr, l.attr_type as kind, trim(value) as v
  from dblist_attrs a join (select distinct noun, attr, attr_type from noun_layout) l
    on l.noun = upper(substr(trim(a.kind), 1, 4)) and l.attr = upper(trim(a.key))
  where value is not null and trim(value) <> '' and lower(trim(value)) <> 'unset'),
parts as (
  select *,
    regexp_extract(v, '^([+-]?[0-9]+(?:\.[0-9]+)?)(?: ?((?i:mm|cm|m|degc|pascal|kpa|kg)))?$', ['n', 'u']) as r,
    regexp_extract(v, '^([XEYNZU]) ([+-]?[0-9]+(?:\.[0-9]+)?)(?: ?((?i:mm|cm|m|degc|pascal|kpa|kg)))? ([XEYNZU]) ([+-]?[0-9]+(?:\.[0-9]+)?)(?: ?((?i:mm|cm|m|degc|pascal|kpa|kg)))? ([XEYNZU]) ([+-]?[0-9]+(?:\.[0-9]+)?)(?: ?((?i:mm|cm|m|degc|pascal|kpa|kg)))?$',
      ['a1', 'n1', 'u1', 'a2', 'n2', 'u2', 'a3', 'n3', 'u3']) as p
  from lines),
axes as (
  select *, translate(p.a1, 'XEYNZU', 'xxyyzz') as b1, translate(p.a2, 'XEYNZU', 'xxyyzz') as b2, translate(p.a3, 'XEYNZU', 'xxyyzz') as b3,
    try_cast(p.n1 as double) * case lower(p.u1) when 'cm' then 10 when 'm' then 1000 when 'kpa' then 1000 else 1 end as c1,
    try_cast(p.n2 as double) * case lower(p.u2) when 'cm' then 10 when 'm' then 1000 when 'kpa' then 1000 else 1 end as c2,
    try_cast(p.n3 as double) * case lower(p.u3) when 'cm' then 10 when 'm' then 1000 when 'kpa' then 1000 else 1 end as c3
  from parts),
vals as (
  select source, elem_no, attr, kind, v,
    case when kind = 'Integer' and regexp_matches(v, '^[+-]?[0-9]+$') then cast(v as double)
         when kind = 'Real' and r.n <> '' then cast(r.n as double) * case lower(r.u) when 'cm' then 10 when 'm' then 1000 when 'kpa' then 1000 else 1 end
         when kind = 'Boolean' and starts_with('true', lower(v)) then 1
         when kind = 'Boolean' and starts_with('false', lower(v)) then 0
         when kind = 'Position' and p.a1 <> '' and b1 <> b2 and b2 <> b3 and b1 <> b3 then case 'x' when b1 then c1 when b2 then c2 else c3 end end as x,
    case when kind = 'Position' and p.a1 <> '' and b1 <> b2 and b2 <> b3 and b1 <> b3 then case 'y' when b1 then c1 when b2 then c2 else c3 end end as y,
    case when kind = 'Position' and p.a1 <> '' and b1 <> b2 and b2 <> b3 and b1 <> b3 then case 'z' when b1 then c1 when b2 then c2 else c3 end end as z,
    case when kind = 'Reference' and regexp_matches(v, '^(=[0-9]+/[0-9]+|/[^\s]+)$') then v
         when kind in ('Text', 'Enum') then case when length(v) > 1 and starts_with(v, '''') and ends_with(v, '''') then substr(v, 2, length(v) - 2) else v end end as t
  from axes),
cells as (
  select source, elem_no, attr, bool_or(x is null and t is null) or max(x) - min(x) > 0.002000001 or max(y) - min(y) > 0.002000001 or max(z) - min(z) > 0.002000001 or coalesce(min(t) <> max(t), false) as bad,
    min(x) as x, min(y) as y, min(z) as z, min(t) as t, min(kind) as kind
  from vals group by 1, 2, 3)
"""

_NUMBER = "concat('n', cast(cast({0} as double) as float) + cast(0 as float))"
_JSON_TEXT = (
    "case when json_type(value) = 'NULL' then null when json_type(value) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then 'n' || (cast(cast(value as double) as float) + 0::float)::varchar"
    " when json_type(value) = 'ARRAY' then '[' || coalesce(array_to_string([case when json_type(x) in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'n' || (cast(cast(x as double) as float) + 0::float)::varchar else coalesce(x::varchar, 'null') end for x in cast(value as json[])], ','), '') || ']'"
    " else 'j' || value::varchar end"
)

_P2 = f"""
with standing as (
  select dbnum, ses_no, ref0, ref1, max((coalesce(captured_at, timestamp '0001-01-01'), coalesce(whole_attmap, ''))) as r
  from element_snapshots where dbnum is not null and ses_no is not null and ref0 is not null and ref1 is not null group by 1, 2, 3, 4),
series as (select dbnum, ses_no, lead(ses_no) over (partition by dbnum order by ses_no) as next_ses from (select distinct dbnum, ses_no from standing)),
cells as (
  select s.dbnum, s.ses_no, s.ref0, s.ref1, e.key as attr, {_JSON_TEXT.replace('value', 'e.value')} as val
  from standing s, json_each(case when json_valid(r[2]) then r[2] else '{{}}' end) e where e.key not in ('PGNO', 'SESNO')),
attrs as (select * from cells where val is not null),
added as (
  select n.dbnum, n.ses_no, n.ref0, n.ref1 from standing n join series s on s.dbnum = n.dbnum and s.next_ses = n.ses_no
  where not exists (select 1 from standing o where o.dbnum = n.dbnum and o.ses_no = s.ses_no and o.ref0 = n.ref0 and o.ref1 = n.ref1)),
removed as (
  select o.dbnum, s.next_ses as ses_no, o.ref0, o.ref1 from standing o join series s on s.dbnum = o.dbnum and s.ses_no = o.ses_no
  where s.next_ses is not null and not exists (select 1 from standing n where n.dbnum = o.dbnum and n.ses_no = s.next_ses and n.ref0 = o.ref0 and n.ref1 = o.ref1)),
kept as (
  select o.dbnum, s.ses_no as old_ses, s.next_ses as ses_no, o.ref0, o.ref1 from standing o join series s on s.dbnum = o.dbnum and s.ses_no = o.ses_no
  join standing n on n.dbnum = o.dbnum and n.ses_no = s.next_ses and n.ref0 = o.ref0 and n.ref1 = o.ref1),
sides as (
  select k.dbnum, k.ses_no, k.ref0, k.ref1, a.attr, a.val, 0 as side from kept k join attrs a on a.dbnum = k.dbnum and a.ses_no = k.old_ses and a.ref0 = k.ref0 and a.ref1 = k.ref1
  union all
  select k.dbnum, k.ses_no, k.ref0, k.ref1, a.attr, a.val, 1 from kept k join attrs a on a.dbnum = k.dbnum and a.ses_no = k.ses_no and a.ref0 = k.ref0 and a.ref1 = k.ref1),
changed as (select dbnum, ses_no, ref0, ref1, attr from sides group by all having min(side) = max(side) or min(val) <> max(val)),
found as (
  select dbnum, ses_no, ref0, ref1, 'added' as diff_type, '' as attr from added
  union all select dbnum, ses_no, ref0, ref1, 'removed', '' from removed
  union all select dbnum, ses_no, ref0, ref1, 'changed', attr from changed)
"""

_P3 = """
with vals as (
  select distinct dbnum, ref0, ref1, sesno, key,
    case when v_int is not null then 'n' || (cast(cast(v_int as double) as float) + 0::float)::varchar
         when v_double is not null then 'n' || (cast(v_double as float) + 0::float)::varchar
         when v_bool is not null then 'b' || v_bool::varchar when v_str is not null then 's' || v_str
         when v_doubles is not null then '[' || array_to_string([(cast(x as float) + 0::float)::varchar for x in v_doubles], ',') || ']'
         when v_refs is not null then 'r' || v_refs::varchar end as val
  from attrs_long where key not in ('PGNO', 'SESNO')),
maps as (select dbnum, ref0, ref1, sesno, string_agg(key || chr(1) || val, chr(2) order by key, val) as m from vals where val is not null group by 1, 2, 3, 4),
standing as (select dbnum, ref0, ref1, sesno, max((byte_offset, deleted)) as v from element_versions group by 1, 2, 3, 4),
points as (select dbnum, ref0, ref1, sesno from standing union select dbnum, ref0, ref1, sesno from attrs_long),
states as (
  select p.*, coalesce(s.v[2], false) as gone, case when coalesce(s.v[2], false) then null else coalesce(m.m, '') end as m
  from points p left join standing s using (dbnum, ref0, ref1, sesno) left join maps m using (dbnum, ref0, ref1, sesno)),
moves as (
  select * from (select *, row_number() over w as n, lag(m) over w as last_m from states window w as (partition by dbnum, ref0, ref1 order by sesno))
  where n = 1 or m is distinct from last_m),
periods as (select *, coalesce(lead(sesno) over (partition by dbnum, ref0, ref1 order by sesno), 0) as to_sesno from moves)
select distinct ref0, ref1, sesno as from_sesno, to_sesno from periods where not gone
"""

_P3_AS_OF = """
with standing as (select dbnum, ref0, ref1, sesno, max((byte_offset, deleted)) as v from element_versions group by 1, 2, 3, 4),
points as (select dbnum, ref0, ref1, sesno from standing union select dbnum, ref0, ref1, sesno from attrs_long),
last as (select dbnum, ref0, ref1, max(sesno) as sesno from points where sesno <= 20 group by 1, 2, 3),
live as (select l.* from last l left join standing s using (dbnum, ref0, ref1, sesno) where not coalesce(s.v[2], false))
select distinct dbnum, ref0, ref1, key, cast(cast(coalesce(v_int, v_double) as float) as double) as number, case when v_int is null and v_double is null then coalesce(v_bool::varchar, v_str) end as text
from attrs_long join live using (dbnum, ref0, ref1, sesno)
where key not in ('PGNO', 'SESNO') and not (v_int is null and v_double is null and v_bool is null and v_str is null and v_doubles is null and v_refs is null)
"""

_P4 = """
with ops as (
  select ref0, ref1, sesno, op_no, min(case upper(trim(operation_type)) when '新增' then 'a' when 'ADD' then 'a' when '修改' then 'm' when 'MODIFIED' then 'm' when '删除' then 'd' when 'DELETED' then 'd' else 'n' end) as kind,
    max(details) as details
  from changes group by 1, 2, 3, 4),
ends as (select ref0, ref1, max((sesno, op_no, kind)) as e from ops where kind in ('a', 'd') group by 1, 2),
live as (select o.*, from ops o join ends using (ref0, ref1) where e[3] = 'a' and kind in ('a', 'm') and (sesno, op_no) >= (e[1], e[2])),
events as (
  select ref0, ref1, sesno, op_no, key as attr, true as sets from live, json_each(json_extract(details, '$.whole_attmap')) where kind = 'a'
  union all select ref0, ref1, sesno, op_no, key, true from live, json_each(json_extract(details, '$.added_attrs')) where kind = 'm'
  union all select ref0, ref1, sesno, op_no, key, true from live, json_each(json_extract(details, '$.modified_attrs')) where kind = 'm'
  union all select ref0, ref1, sesno, op_no, key, false from live, json_each(json_extract(details, '$.deleted_attrs')) where kind = 'm'),
last as (select ref0, ref1, attr, max((sesno, op_no, sets)) as x from events group by 1, 2, 3)
select ref0, ref1, attr, x[1] as sesno, x[2] as op_no from last where x[3]
"""

_P5 = """
with standing as (
  select dbnum, ref0, ref1, sesno, deleted, owner_ref0, owner_ref1, children from (
    select *, row_number() over (partition by dbnum, ref0, ref1, sesno order by byte_offset desc, deleted desc) as n from element_versions) where n = 1),
refs as (
  select 'owner' as ref_field, dbnum, sesno, ref0, ref1, owner_ref0 as target_ref0, owner_ref1 as target_ref1 from standing where not deleted
  union select 'children', dbnum, sesno, ref0, ref1, c.ref0, c.ref1 from (select dbnum, sesno, ref0, ref1, unnest(children) as c from standing where not deleted)
  union select 'index', dbnum, sesno, ref0, ref1, ref0, ref1 from index_entries where level = 0),
named as (select * from refs where target_ref0 is not null and target_ref1 is not null and not (target_ref0 = 0 and target_ref1 = 0) and not (target_ref0 = 2147483649 and target_ref1 = 2147483649)),
known as (select dbnum, ref0, ref1 from standing group by 1, 2, 3),
judged as (
  select r.*, v.deleted as gone, k.dbnum is not null as known from named r
  left join known k on k.dbnum = r.dbnum and k.ref0 = r.target_ref0 and k.ref1 = r.target_ref1
  asof left join standing v on v.dbnum = r.dbnum and v.ref0 = r.target_ref0 and v.ref1 = r.target_ref1 and r.sesno >= v.sesno),
found as (
  select ref_field, dbnum, sesno, ref0, ref1, target_ref0, target_ref1, case when not known then 'missing' when gone is null then 'later' else 'deleted' end as miss_kind
  from judged where not known or gone is null or gone)
"""

_P6 = """
with recursive last as (
  select ref0, ref1, owner_ref0, owner_ref1, children from (
    select *, row_number() over (partition by ref0, ref1 order by sesno desc, byte_offset desc, deleted desc) as n from element_versions) where n = 1 and not deleted),
held as (select c.ref0, c.ref1, min((h0, h1)) as low, max((h0, h1)) as high from (select ref0 as h0, ref1 as h1, unnest(children) as c from last) group by 1, 2),
links as (
  select l.ref0, l.ref1,
    case when coalesce(l.owner_ref0, 0) = 0 and coalesce(l.owner_ref1, 0) = 0 then case when h.low = h.high then h.low end when o.ref0 is not null then (l.owner_ref0, l.owner_ref1) end as parent
  from last l left join last o on o.ref0 = l.owner_ref0 and o.ref1 = l.owner_ref1 left join held h on h.ref0 = l.ref0 and h.ref1 = l.ref1),
down as (
  select ref0, ref1, ref0 as root_ref0, ref1 as root_ref1, 0 as depth from links where parent is null
  union all
  select k.ref0, k.ref1, d.root_ref0, d.root_ref1, d.depth + 1 from down d join links k on k.parent = (d.ref0, d.ref1)),
found as (select l.ref0, l.ref1, coalesce(d.root_ref0, 0) as root_ref0, coalesce(d.root_ref1, 0) as root_ref1, coalesce(d.depth, -1) as depth from links l left join down d using (ref0, ref1))
select ref0, ref1, root_ref0, root_ref1, depth from found
"""

_P6_PATHS = _P6.replace("0 as depth from links", "0 as depth, [ref0 || '/' || ref1] as path from links").replace("d.depth + 1 from down", "d.depth + 1, list_append(d.path, k.ref0 || '/' || k.ref1) from down")
_P6_PATHS = (
    _P6_PATHS[: _P6_PATHS.index("found as (")]
    + """below as (select a as node, count(*) as n from (select unnest(path[:-2]) as a from down) group by 1)
select l.ref0, l.ref1, coalesce(d.depth, -1) as depth, case when d.depth is not null then coalesce(b.n, 0) end as n_descendants, array_to_string(d.path, ' > ') as path
from links l left join down d using (ref0, ref1) left join below b on b.node = l.ref0 || '/' || l.ref1
"""
)

_P6_SUBTREES = _P6_PATHS[: _P6_PATHS.index("below as (")] + """sums as (select a as node, sum(ref1) as total from (select unnest(path) as a, ref1 from down) group by 1)
select l.ref0, l.ref1, cast(s.total as bigint) as total from links l join sums s on s.node = l.ref0 || '/' || l.ref1
"""

ORACLES: dict[str, str] = {
    "p1_found": f"with {_P1_LINES} select source, elem_no, attr as key from cells where bad",
    "p1_cells": f"""with {_P1_LINES}, stored as (select distinct attr, case attr_type when 'Integer' then 'integer' when 'Real' then 'number' when 'Boolean' then 'boolean' when 'Position' then 'position' else 'text' end as stored from noun_layout),
      several as (select attr, count(*) > 1 as several from stored group by 1)
      select source, elem_no, case when several then attr || '_' || case kind when 'Integer' then 'integer' when 'Real' then 'number' when 'Boolean' then 'boolean' when 'Position' then 'position' else 'text' end else attr end as column,
        case when kind in ('Integer', 'Real') then x end as number, case kind when 'Boolean' then (x = 1)::varchar when 'Position' then concat_ws(' ', round(x, 3)::double, round(y, 3)::double, round(z, 3)::double) else t end as text
      from cells join several using (attr) where not coalesce(bad, false)""",
    "p2_found": _P2 + "select dbnum, ses_no, ref0, ref1, diff_type, attr from found",
    "p2_summary": _P2 + "select dbnum, ses_no, diff_type, count(distinct (ref0, ref1)) as n_elements, count(*) as n_rows from found group by 1, 2, 3",
    "p3_found": _P3,
    "p3_as_of": _P3_AS_OF,
    "p4_found": _P4,
    "p5_found": _P5 + "select * from found",
    "p5_report": _P5 + "select ref_field, dbnum, sesno, miss_kind, count(*) as n_references, count(distinct (target_ref0, target_ref1)) as n_targets from found group by 1, 2, 3, 4",
    "p6_found": _P6,
    "p6_paths": _P6_PATHS,
    "p6_subtrees": _P6_SUBTREES,
}
