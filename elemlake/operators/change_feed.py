"""Applying a feed of inserts, updates and deletes as a signed multiset.

Every operation that takes effect contributes, per attribute, plus one for
the row it writes (after-image) and minus one for the row it replaces
(before-image). A row is (element, attribute, sesno, op_no of its writer).
The present state is the base plus the sum of all contributions: the rows of
positive multiplicity.

An operation's before-images are found by order, not trusted from the feed:
the last write of the same attribute in the same life of the element, and,
for an operation that starts or ends a life, whatever the life before it left.
Repeated deliveries are reduced to one operation first, and order comes from
(sesno, op_no), so neither repetition nor late arrival changes the result.

Defined results: operations without ref0 or ref1 name no element and take no
part; a null sesno or op_no sorts before every other; a null or unreadable
detail carries no attributes; an unknown operation_type is None; of repeated
deliveries that differ, the one with details and then the lowest change_id
counts; an attribute both removed and set by one operation is set; an empty
feed leaves the base.

Group sizes: elements with more operations than ROWS_PER_BLOCK, which is what a
task sorts, are cut into blocks of about that many in their order
(plans.skew), so the number of blocks grows with the element; the others are
one block each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elemlake.plans.skew import carry_forward, cut_groups, long_groups
from elemlake.plans.workspace import written

ELEMENT = ["ref0", "ref1"]
#: Operations of one element that one task may sort.
ROWS_PER_BLOCK = 100_000

# The sesno of a base, before every other and before null.
BASE = -(1 << 31)

# Spellings of the operation types, compared without outer blanks and case.
OPERATIONS = {"新增": "add", "ADD": "add", "修改": "modify", "MODIFIED": "modify", "删除": "delete", "DELETED": "delete", "无操作": "none", "NONE": "none"}

_DETAILS = "struct<whole_attmap:map<string,variant>,added_attrs:map<string,variant>,deleted_attrs:map<string,variant>,modified_attrs:map<string,variant>>"


def operation(label: Column) -> Column:
    """add, modify, delete or none."""
    spelled = F.upper(F.trim(label))
    kind = F.lit("none")
    for name, short in OPERATIONS.items():
        kind = F.when(spelled == name, F.lit(short)).otherwise(kind)
    return kind


def position(sesno: str = "sesno", op_no: str = "op_no") -> Column:
    """The order of operations as one integer: sesno in the high word, -1 if null; op_no plus one in the low word, 0 if null."""
    return F.shiftleft(F.coalesce(F.col(sesno), F.lit(-1)).cast("bigint"), 32) + F.coalesce(F.col(op_no).cast("bigint") + 1, F.lit(0).cast("bigint"))


def place(at: Column) -> tuple[Column, Column]:
    """sesno and op_no of a position."""
    sesno, op_no = F.shiftright(at, 32).cast("int"), at.bitwiseAND(F.lit((1 << 32) - 1)) - 1
    return F.when(sesno != -1, sesno), F.when(op_no >= 0, op_no).cast("int")


def operations(changes: DataFrame) -> DataFrame:
    """One row per operation: (ref0, ref1, at, kind, details); repeated deliveries are combined before the shuffle."""
    named = changes.where("ref0 is not null and ref1 is not null")
    rows = named.select(*ELEMENT, position().alias("at"), F.struct(F.col("details").isNull().alias("blank"), "change_id", operation(F.col("operation_type")).alias("kind"), "details").alias("delivery"))
    return rows.groupBy(*ELEMENT, "at").agg(F.min("delivery").alias("d")).select(*ELEMENT, "at", "d.kind", "d.details")


def lives(ops: DataFrame, groups: DataFrame | None, rows_per_block: int) -> DataFrame:
    """ops with the life each belongs to: the last add or delete at or before it (`life`), and the one it ends, if any (`ended_life`).

    Operations that take no effect are left out.
    """
    blocked = cut_groups(ops, ELEMENT, "at", groups, rows_per_block)
    mark = F.when(F.col("kind").isin("add", "delete"), F.struct("at", "kind"))
    before = carry_forward(blocked, ELEMENT, "block", ["at"], mark, "last_life", inclusive=False, split=False if groups is None else F.col("is_long"))
    exists = F.coalesce(F.col("last_life.kind") == "add", F.lit(False))
    effective = (F.col("kind") == "add") | (F.col("kind").isin("modify", "delete") & exists)
    life = F.when(F.col("kind") == "modify", F.col("last_life.at")).otherwise(F.col("at"))
    ended = F.when(F.col("kind").isin("add", "delete") & exists, F.col("last_life.at"))
    return before.where(effective).select(*ELEMENT, "at", "block", "is_long", "kind", life.alias("life"), ended.alias("ended_life"), "details")


def attribute_events(effective: DataFrame) -> DataFrame:
    """(ELEMENT, attr, at, block, is_long, life, sets, value): what each operation does to each attribute; a row without attr ends a life."""
    parsed = effective.withColumn("d", F.from_json(F.when(F.col("kind") != "delete", F.col("details")), _DETAILS))
    parsed = parsed.select("*", *[F.map_keys(f"d.{f}").alias(f"{f}_keys") for f in ("added_attrs", "modified_attrs")])
    none = "cast(array() as array<struct<attr:string,life:bigint,sets:boolean,value:variant>>)"

    def items(field: str, sets: bool, value: str, but: str = "") -> str:
        entries = f"map_entries(d.{field})"
        for keys in but.split():
            entries = f"filter({entries}, e -> not array_contains(coalesce({keys}, cast(array() as array<string>)), e.key))"
        return f"coalesce(transform({entries}, e -> struct(e.key as attr, life as life, {str(sets).lower()} as sets, {value} as value)), {none})"

    # Each attribute once an operation: modified before added before deleted.
    new = "coalesce(try_variant_get(e.value, '$[1]', 'variant'), parse_json('null'))"
    whole = items("whole_attmap", True, "e.value")
    part = f"concat({items('modified_attrs', True, new)}, {items('added_attrs', True, 'e.value', 'modified_attrs_keys')}, {items('deleted_attrs', False, 'cast(null as variant)', 'modified_attrs_keys added_attrs_keys')})"
    end = f"if(ended_life is null, {none}, array(struct(cast(null as string) as attr, ended_life as life, false as sets, cast(null as variant) as value)))"
    events = parsed.select(*ELEMENT, "at", "block", "is_long", F.explode(F.expr(f"concat({end}, case kind when 'add' then {whole} when 'modify' then {part} else {none} end)")).alias("e"))
    return events.select(*ELEMENT, "e.attr", "at", "block", "is_long", "e.life", "e.sets", F.to_json("e.value").alias("value"))


def contributions(events: DataFrame, cut: bool) -> DataFrame:
    """Signed rows (ELEMENT, attr, at, value, m). Only after-images carry values; a before-image names its row by the writer. cut says whether there are elements of several blocks."""
    nothing = F.lit(None).cast("string").alias("value")
    acts = events.where("attr is not null")
    after = acts.where("sets").select(*ELEMENT, "attr", "at", "value", F.lit(1).alias("m"))

    # Within a life: each event replaces the write before it.
    slim = acts.select(*ELEMENT, "attr", "life", "block", "is_long", "at", "sets")
    replaced = carry_forward(slim, [*ELEMENT, "attr", "life"], "block", ["at"], F.struct("at", "sets"), "before", inclusive=False, split=F.col("is_long") if cut else False)
    before = replaced.where("before.sets").select(*ELEMENT, "attr", F.col("before.at").alias("at"), nothing, F.lit(-1).alias("m"))

    # The end of a life replaces all that it left.
    ends = events.where("attr is null").select(*ELEMENT, "life")
    left = slim.join(ends, [*ELEMENT, "life"], "left_semi").groupBy(*ELEMENT, "attr", "life").agg(F.max(F.struct("at", "sets")).alias("x")).where("x.sets")
    closed = left.select(*ELEMENT, "attr", "x.at", nothing, F.lit(-1).alias("m"))
    return after.unionByName(before).unionByName(closed)


def current_attributes(changes: DataFrame, base: DataFrame | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The attributes of every existing element: (ref0, ref1, attr, value, sesno, op_no).

    base: an earlier result; its elements take part as added by the operations
    it names, so the feed must hold only operations after them.
    """
    if base is not None:
        # A base element is one life, begun before every operation of the feed.
        fields = F.map_from_entries(F.collect_list(F.struct("attr", F.expr("parse_json(value)"))))
        begun = base.groupBy(*ELEMENT).agg(F.to_json(F.struct(fields.alias("whole_attmap"))).alias("details"))
        start = begun.select(*ELEMENT, F.lit(BASE).cast("int").alias("sesno"), F.lit(None).cast("int").alias("op_no"), F.lit(None).cast("bigint").alias("change_id"), F.lit("Add").alias("operation_type"), "details")
        changes = start.unionByName(changes.select(*start.columns))
    placed = changes.where("ref0 is not null and ref1 is not null").select(*ELEMENT, position().alias("at"))
    groups = long_groups(placed, ELEMENT, "at", rows_per_block)
    events = written(attribute_events(lives(operations(changes), groups, rows_per_block)), "attribute-events")  # read several times below
    signed = contributions(events, groups is not None)
    state = signed.groupBy(*ELEMENT, "attr", "at").agg(F.sum("m").alias("m"), F.max("value").alias("value")).where("m > 0")
    sesno, op_no = place(F.col("at"))
    out = state.select(*ELEMENT, "attr", "value", sesno.alias("sesno"), op_no.alias("op_no"))
    if base is None:
        return out
    untouched = base.select(*ELEMENT, "attr", F.col("sesno").alias("base_sesno"), F.col("op_no").alias("base_op_no"))
    from_base = F.col("sesno").eqNullSafe(F.lit(BASE))
    return out.join(untouched, [*ELEMENT, "attr"], "left").select(*ELEMENT, "attr", "value", F.when(from_base, F.col("base_sesno")).otherwise(F.col("sesno")).alias("sesno"), F.when(from_base, F.col("base_op_no")).otherwise(F.col("op_no")).alias("op_no"))
