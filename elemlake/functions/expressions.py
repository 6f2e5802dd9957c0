"""The expression language of stored attributes: postfix words to a tree, to text, and to Spark columns.

A payload is a length word and that many big-endian 32-bit words. Values
push themselves, operators take their operands from the stack. The tree is
printed in one of two dialects (``infix`` with spaces and as few brackets as
precedence allows; ``template`` tight and fully bracketed) or compiled to a Column,
so that an expression over attributes runs inside Catalyst.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elemlake.functions.names import python_name_of_hash

# Binding strength of each form.
OR, AND, NOT, COMPARE, ADD, MULTIPLY, NEGATE, FUNCTION, VALUE = 10, 20, 30, 40, 60, 70, 80, 90, 100

# Infix operators: opcode, sign, binding, and whether an equally binding right operand needs brackets.
INFIX = {
    302: ("AND", AND, False), 303: ("OR", OR, False), 401: ("EQ", COMPARE, False), 501: ("NEQ", COMPARE, False),
    601: ("GT", COMPARE, False), 602: ("GT", COMPARE, False), 603: ("LT", COMPARE, False), 605: ("GE", COMPARE, False), 607: ("LE", COMPARE, False),
    802: ("+", ADD, False), 803: ("-", ADD, True), 804: ("*", MULTIPLY, False), 805: ("/", MULTIPLY, True),
}

# Functions: opcode, name, number of operands.
FUNCTIONS = {
    901: ("SIN", 1), 902: ("COS", 1), 903: ("TAN", 1), 904: ("ASIN", 1), 905: ("ACOS", 1), 906: ("ATAN", 1), 907: ("ATAN2", 2),
    1001: ("SQRT", 1), 1002: ("POW", 2), 1003: ("LOG", 1), 1004: ("ALOG", 1), 1005: ("INT", 1), 1006: ("NINT", 1), 1007: ("ABS", 1), 1008: ("MAX", 2), 1009: ("MIN", 2), 1010: ("NOMBORE", 1), 1011: ("DISTCONVERT", 1), 1012: ("REAL", 1),
    1101: ("COMP", 2), 1102: ("ARRAY", 2), 1103: ("ARRAY", 2),
    1301: ("LENGTH", 1), 1302: ("REAL", 1), 1303: ("MATCH", 2), 1304: ("AFTER", 2), 1305: ("BEFORE", 2), 1306: ("STRING", 2), 1307: ("UPCASE", 1), 1308: ("LOWCASE", 1), 1309: ("SUBSTRING", 3), 1311: ("DEFINED", 1), 1312: ("UNDEFINED", 1), 1313: ("SIZE", 1), 1314: ("TRIM", 1), 1315: ("MATCHWILD", 2), 1316: ("WIDTH", 1), 1317: ("PART", 2), 1321: ("OCCURS", 2), 1322: ("REPLACE", 3),
    1369: ("VTEXT", 2), 1370: ("VVALUE", 2), 1401: ("REAL", 1), 1410: ("STR", 1),
    1822: ("IFTRUE", 3), 1824: ("DISTCONVERT", 1), 1825: ("SET", 2), 1826: ("UNSET", 1), 1827: ("ARRAY", 2), 1828: ("EMPTY", 1), 1829: ("SPLIT", 2),
}
VARIABLES = range(1201, 1221)

# Value opcodes.
NUMBER, TEXTS, BOOLEAN, VARIABLE, IDENTIFIER, ATTRIBUTE, PI, WORDS = 0x65, (0x66, 0x76), 0x67, 0x68, 0x69, 0x6A, 0x6F, (0x72, 0x74, 0x75)
HEADER_MARKS = {0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x6B, 0x6C, 0x6D, 0x6F, 0x70, 0x71, 0x72, 0x74, 0x75, 0x76}
TRUE = 201
#: Highest hash that is a name of six letters.
MOST_NAME_HASH = 387_951_929


class ExpressionError(ValueError):
    """The words are no expression; opcode is the first one that is unknown, if that is why."""

    def __init__(self, why: str, opcode: int | None = None):
        super().__init__(why)
        self.opcode = opcode


@dataclass
class Node:
    kind: str  # number, text, boolean, variable, id, attribute, pi, word, infix, negate, not, call
    value: object = None
    args: list["Node"] = field(default_factory=list)
    opcode: int = 0


# Words to tree


class _Reader:
    def __init__(self, words: list[int]):
        self.words, self.at = words, 0

    def take(self, n: int = 1) -> list[int]:
        if n < 0 or self.at + n > len(self.words):
            raise ExpressionError("the words end inside a value")
        out = self.words[self.at : self.at + n]
        self.at += n
        return out

    def peek(self) -> int | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def block(self) -> list[int]:
        """A block that begins with its own length."""
        n = self.take()[0]
        if n <= 0:
            raise ExpressionError("a block without length")
        return self.take(n - 1)


def stored_number(a: int, b: int, c: int) -> float:
    """A real in three words: parts of an IEEE double, or two scaled integers and a power of two."""
    a, b, c = (x & 0xFFFFFFFF for x in (a, b, c))
    if c & 0xC0000000 == 0x40000000:
        high = (a & 0x1FFFFF) | ((c & 0x7FF) << 20) | (0x80000000 if a & 0x40000000 else 0)
        return struct.unpack(">d", struct.pack(">II", high, b))[0]
    signed = [x - (1 << 32) if x >> 31 else x for x in (a, b, c)]
    try:
        return math.ldexp(signed[0] * 2.0**-15 + signed[1] * 2.0**-30, signed[2])
    except OverflowError:
        return math.inf


def _latin(words: list[int]) -> str:
    return bytes(w & 0xFF for w in words).decode("utf-8", "replace")


def _name(value: int) -> str | None:
    return python_name_of_hash(value)


def _value(reader: _Reader, opcode: int, stack: list[Node]) -> Node | None:
    if opcode == NUMBER:
        count = reader.take()[0]
        if count <= 1:
            raise ExpressionError("a number without words")
        data = reader.take(count - 1)
        if len(data) < 3:
            return Node("number", (data[0], 0))
        return Node("number", (stored_number(*data[:3]), data[3] if len(data) > 3 else 0))
    if opcode in TEXTS or opcode == VARIABLE:
        return Node("variable" if opcode == VARIABLE else "text", _latin(reader.take(reader.take()[0])))
    if opcode == BOOLEAN:
        return Node("boolean", reader.take()[0] == TRUE)
    if opcode == IDENTIFIER:
        count = reader.take()[0]
        if count <= 0:
            raise ExpressionError("an identifier without words")
        return Node("id", [w & 0xFFFFFFFF for w in reader.take(count)])
    if opcode == PI:
        return Node("pi")
    if opcode in WORDS:
        value = reader.take()[0]
        return Node("word", _name(value) or f"0x{value & 0xFFFFFFFF:08X}")
    if opcode == ATTRIBUTE:
        return _attribute(reader, stack)
    return None


def _attribute(reader: _Reader, stack: list[Node]) -> Node:
    _, hashed, low, high, suffix = reader.take(5)
    name = _name(hashed) or "unknown attribute"
    info = {"name": name, "known": abs(hashed) <= MOST_NAME_HASH, "low": low, "high": high, "suffix": None, "of": None}
    args: list[Node] = []
    if suffix:
        info["suffix"] = _name(suffix) or (str(suffix) if 0 < suffix <= 531441 else f"0x{suffix & 0xFFFFFFFF:08X}")
    elif low == -1 and stack:
        args = [stack.pop()]
    # Trailers: qualifiers with their own operands, a unit, the element whose attribute is meant, and a target. Only that element is kept.
    if reader.peek() == 2100:
        reader.take()
        for _ in range(reader.take()[0]):
            if not stack:
                raise ExpressionError("an operand is missing")
            stack.pop()
            reader.take()
    if reader.peek() == 2200:
        reader.take(3)
    for plain, blocks, triples in ((1601, 1602, None), (1701, 1702, 1703)):
        mark = reader.peek()
        if mark == plain:
            reader.take()
        elif mark == blocks:
            reader.take()
            words = reader.block()
            if blocks == 1602 and len(words) >= 2 and words[0] and words[1] not in (0, 1701):
                info["of"] = tuple(w & 0xFFFFFFFF for w in words[:2])
        elif mark is not None and mark == triples:
            reader.take(3)
    return Node("attribute", info, args)


def _operator(opcode: int, stack: list[Node]) -> Node | None:
    def pop(n: int) -> list[Node]:
        if len(stack) < n:
            raise ExpressionError("an operand is missing")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    if opcode in INFIX:
        return Node("infix", None, pop(2), opcode)
    if opcode == 301:
        return Node("not", None, pop(1), opcode)
    if opcode == 801:
        return Node("negate", None, pop(1), opcode)
    if opcode in FUNCTIONS:
        return Node("call", FUNCTIONS[opcode][0], pop(FUNCTIONS[opcode][1]), opcode)
    if opcode in VARIABLES:
        return Node("call", f"VAR{opcode - 1200}", pop(1) if stack else [], opcode)
    return None


def tree_of_words(words: list[int]) -> Node:
    reader, stack = _Reader(words), []
    while (opcode := reader.peek()) is not None:
        reader.take()
        node = _value(reader, opcode, stack) or _operator(opcode, stack)
        if node is None:
            raise ExpressionError(f"opcode {opcode} is unknown", opcode)
        stack.append(node)
    if len(stack) != 1:
        raise ExpressionError(f"{len(stack)} values are left instead of one")
    return stack[0]


def payload_words(payload: bytes, skip: int = 0) -> list[int]:
    """The words of the expression proper, if the payload starts after `skip` words."""
    if len(payload) < 4 * skip + 4:
        raise ExpressionError("the payload is too short")
    count = struct.unpack_from(">i", payload, 4 * skip)[0]
    if count < 0 or len(payload) < 4 * (skip + 1 + count):
        raise ExpressionError("the declared length is wrong")
    words = list(struct.unpack_from(f">{count}i", payload, 4 * skip + 4))
    header = 2 if count >= 3 and words[0] == count and words[1] == 1 and words[2] in HEADER_MARKS else 1
    return words[header:]


def tree_of_payload(payload: bytes) -> Node:
    """The tree from whichever of the first three words as start gives the most words."""
    best, why = None, ExpressionError("the payload is too short")
    for skip in range(3):
        try:
            words = payload_words(payload, skip)
            if words and (best is None or len(words) > best[0]):
                best = len(words), tree_of_words(words)
        except ExpressionError as e:
            why = e if e.opcode is not None or why.opcode is None else why
    if best is None:
        raise why
    return best[1]


def opcode_counts(payload: bytes) -> tuple[dict[int, int], list[int]]:
    """How often each opcode occurs, and the unknown ones; of the possible starts, the one with the fewest unknown and then the longest."""
    found = []
    for skip in range(3):
        try:
            words = payload_words(payload, skip)
        except ExpressionError:
            continue
        counts: Counter[int] = Counter()
        unknown, reader = set(), _Reader(words)
        while (opcode := reader.peek()) is not None:
            reader.take()
            counts[opcode] += 1
            try:
                if _value(reader, opcode, [Node("pi")] * 8) is None and not (opcode in INFIX or opcode in FUNCTIONS or opcode in VARIABLES or opcode in (301, 801)):
                    unknown.add(opcode)
            except ExpressionError:
                break
        if counts:
            found.append((len(unknown), -len(words), dict(counts), sorted(unknown)))
    if not found:
        raise ExpressionError("the payload is too short")
    best = min(found, key=lambda x: x[:2])
    return best[2], best[3]


# Tree to text


def number_text(value: float) -> str:
    """At most six decimals, without trailing zeros."""
    if isinstance(value, int):
        return str(value)
    text = f"{value:.6f}".rstrip("0").rstrip(".") if math.isfinite(value) else str(value)
    return "0" if text == "-0" else text


def _leaf(node: Node, dialect: str) -> str | None:
    if node.kind == "number":
        base, power = node.value
        if dialect == "template":
            return number_text(round(float(base) * 10.0**power, 3)) if not isinstance(base, int) or power else str(base)
        return number_text(base) + (f" EX {power}" if power else "")
    if node.kind == "text":
        return "'" + node.value.replace("'", "''") + "'"
    if node.kind == "boolean":
        return "true" if node.value else "false"
    if node.kind == "id":
        return "ID " + " ".join(f"0x{w:08X}" for w in node.value)
    if node.kind == "pi":
        return "PI"
    if node.kind in ("variable", "word"):
        return node.value
    return None


def to_text(node: Node, dialect: str = "infix") -> str:
    if dialect not in ("infix", "template"):
        raise ValueError(f"no dialect {dialect}")
    return _print(node, dialect)[0]


def _print(node: Node, dialect: str) -> tuple[str, int]:
    leaf = _leaf(node, dialect)
    if leaf is not None:
        return leaf, VALUE
    if node.kind == "attribute":
        return _attribute_text(node, dialect), VALUE
    printed = [_print(a, dialect) for a in node.args]
    if dialect == "template":
        texts = [t for t, _ in printed]
        if node.kind == "infix":
            sign, binding, _ = INFIX[node.opcode]
            gap = "" if binding in (ADD, MULTIPLY) else " "
            return f"({texts[0]}{gap}{sign}{gap}{texts[1]})", VALUE
        if node.kind == "negate":
            return f"(-{texts[0]})", VALUE
        if node.kind == "not":
            return f"(NOT {texts[0]})", VALUE
        return (f"{node.value}({','.join(texts)})" if texts else str(node.value)), VALUE

    def within(at: int, least: int) -> str:
        text, binding = printed[at]
        return f"({text})" if binding < least else text

    if node.kind == "infix":
        sign, binding, tight = INFIX[node.opcode]
        return f"{within(0, binding)} {sign} {within(1, binding + 1 if tight else binding)}", binding
    if node.kind == "negate":
        return f"- {within(0, NEGATE)}", NEGATE
    if node.kind == "not":
        return f"NOT {within(0, NOT)}", NOT
    if not printed:
        return str(node.value), VALUE
    return f"{node.value} ( {' , '.join(t for t, _ in printed)} )", FUNCTION


def _attribute_text(node: Node, dialect: str) -> str:
    a = node.value
    if a["of"]:
        own = _attribute_text(Node("attribute", a | {"of": None}, node.args), dialect)
        return f"({own} OF ={a['of'][0]}/{a['of'][1]})"
    text = ("ATTRIB " if a["known"] and dialect == "infix" else "") + a["name"]
    if a["suffix"] is not None:
        return f"{text} {a['suffix']}"
    if node.args:
        return f"{text}[{_print(node.args[0], dialect)[0]} ]"
    low, high = a["low"], a["high"]
    parameter = a["name"] == "PARA"
    if low in (0, -1) or (low == high == 1 and not parameter) or (low == 1 and high == 500 and not parameter):
        return text
    return f"{text}[{low} ]" if high in (low, 0) else f"{text} {low} TO {high}"


# Tree to column


@dataclass
class Options:
    """How the parts that the stored form leaves open are evaluated."""

    degrees: bool = True
    distance_factor: float = 1.0
    bores: dict[float, float] | None = None


def other_elements(node: Node) -> list[tuple[str, int, int]]:
    """(attribute, ref0, ref1) of the attributes that an expression reads from other elements."""
    own = [(node.value["name"], *node.value["of"])] if node.kind == "attribute" and node.value["of"] else []
    return list(dict.fromkeys([*own, *(x for a in node.args for x in other_elements(a))]))


def values_of_others(node: Node, attrs: DataFrame) -> Callable[[str, int, int], Column]:
    """Constants for the attributes of other elements, from (ref0, ref1, sesno, key, value) rows: the newest value each, null if there is none.

    An expression names its elements itself, so they are as few as its words; the rows are looked up in one pass.
    """
    asked = other_elements(node)
    found: dict[tuple, object] = {}
    if asked:
        wanted = F.lit(False)
        for key, ref0, ref1 in asked:
            wanted = wanted | ((F.col("key") == key) & (F.col("ref0") == ref0) & (F.col("ref1") == ref1))
        rows = attrs.where(wanted).groupBy("key", "ref0", "ref1").agg(F.max_by("value", "sesno").alias("value")).collect()
        found = {(r["key"], r["ref0"], r["ref1"]): r["value"] for r in rows}
    kind = attrs.schema["value"].dataType
    return lambda key, ref0, ref1: F.lit(found.get((key, ref0, ref1))).cast(kind)


def compile_expression(node: Node, attribute: Callable[[str], Column], variable: Callable[[str], Column] | None = None, options: Options | None = None, other: Callable[[str, int, int], Column] | None = None) -> Column:
    """The tree as a Column. attribute gives the column of an attribute name, variable that of a variable name, other that of an attribute of another element."""
    options = options or Options()
    variable = variable or attribute

    def go(n: Node) -> Column:
        if n.kind == "number":
            base, power = n.value
            return F.lit(float(base) * 10.0**power)
        if n.kind in ("text", "word"):
            return F.lit(n.value)
        if n.kind == "boolean":
            return F.lit(n.value)
        if n.kind == "pi":
            return F.pi()
        if n.kind == "id":
            return F.lit(" ".join(f"0x{w:08X}" for w in n.value))
        if n.kind == "variable":
            return variable(n.value)
        if n.kind == "attribute":
            if n.value["of"] and other is None:
                raise ExpressionError("an attribute of another element, and no way to it")
            column = other(n.value["name"], *n.value["of"]) if n.value["of"] else attribute(n.value["name"])
            low, high = n.value["low"], n.value["high"]
            if n.args:
                return F.get(column, go(n.args[0]).cast("int") - 1)
            if low > 0 and high > low and not (low == 1 and high == 500):
                return F.substring(column, low, high - low + 1)
            if low > 1 or (low == 1 and n.value["name"] == "PARA"):
                return F.get(column, F.lit(low - 1))
            return column
        args = [go(x) for x in n.args]
        if n.kind == "not":
            return ~args[0]
        if n.kind == "negate":
            return -args[0]
        if n.kind == "infix":
            a, b = args
            return {"AND": lambda: a & b, "OR": lambda: a | b, "EQ": lambda: a == b, "NEQ": lambda: a != b, "GT": lambda: a > b, "LT": lambda: a < b, "GE": lambda: a >= b, "LE": lambda: a <= b,
                    "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[INFIX[n.opcode][0]]()
        if n.opcode in VARIABLES:
            return variable(n.value)
        return _call(n.value, n.opcode, args, options)

    return go(node)


def _call(name: str, opcode: int, args: list[Column], options: Options) -> Column:
    a = args[0]
    b = args[1] if len(args) > 1 else None
    into = F.radians if options.degrees else (lambda x: x)
    out_of = F.degrees if options.degrees else (lambda x: x)
    at = F.instr
    plain = {
        "SIN": lambda: F.sin(into(a)), "COS": lambda: F.cos(into(a)), "TAN": lambda: F.tan(into(a)),
        "ASIN": lambda: out_of(F.asin(a)), "ACOS": lambda: out_of(F.acos(a)), "ATAN": lambda: out_of(F.atan(a)), "ATAN2": lambda: out_of(F.atan2(a, b)),
        "SQRT": lambda: F.sqrt(a), "POW": lambda: F.pow(a, b), "LOG": lambda: F.ln(a), "ALOG": lambda: F.exp(a),
        "INT": lambda: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("bigint"), "NINT": lambda: F.round(a).cast("bigint"), "ABS": lambda: F.abs(a),
        "MAX": lambda: F.greatest(a, b), "MIN": lambda: F.least(a, b),
        "NOMBORE": lambda: _lookup(a, options.bores), "DISTCONVERT": lambda: a * options.distance_factor,
        "REAL": lambda: a.try_cast("double"), "STR": lambda: a.cast("string"),
        "COMP": lambda: F.get(a, b.cast("int") - 1), "ARRAY": lambda: F.get(a, b.cast("int") - 1),
        "LENGTH": lambda: F.length(a), "WIDTH": lambda: F.length(a), "SIZE": lambda: F.size(a), "TRIM": lambda: F.trim(a),
        "UPCASE": lambda: F.upper(a), "LOWCASE": lambda: F.lower(a),
        "MATCH": lambda: at(a, b),
        "AFTER": lambda: F.when(at(a, b) > 0, F.substr(a, at(a, b) + F.length(b))).otherwise(F.lit("")),
        "BEFORE": lambda: F.when(at(a, b) > 0, F.substr(a, F.lit(1), at(a, b) - 1)).otherwise(F.lit("")),
        "STRING": lambda: F.format_number(a, 2) if b is None else F.call_function("format_string", b, a),
        "SUBSTRING": lambda: F.substr(a, b.cast("int"), args[2].cast("int")),
        "DEFINED": lambda: a.isNotNull(), "UNDEFINED": lambda: a.isNull(), "SET": lambda: a.isNotNull(), "UNSET": lambda: a.isNull(), "EMPTY": lambda: a == "",
        "MATCHWILD": lambda: F.call_function("like", a, _wildcards(b)),
        "PART": lambda: F.get(F.split(a, " "), b.cast("int") - 1),
        "OCCURS": lambda: F.try_divide(F.length(a) - F.length(F.replace(a, b, F.lit(""))), F.length(b)).cast("int"),
        "REPLACE": lambda: F.replace(a, b, args[2]),
        "VTEXT": lambda: F.coalesce(a, b), "VVALUE": lambda: F.coalesce(a, b),
        "IFTRUE": lambda: F.when(a, b).otherwise(args[2]),
        "SPLIT": lambda: F.when(b == "", F.array(a)).otherwise(F.split(a, F.concat(F.lit("\\Q"), F.replace(b, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))),
    }
    if name not in plain:
        raise ExpressionError(f"opcode {opcode} cannot be evaluated", opcode)
    return plain[name]()


def _wildcards(pattern: Column) -> Column:
    """A pattern with * and ? for LIKE; whatever means something there and not here stands for itself."""
    for plain, meant in (("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("*", "%"), ("?", "_")):
        pattern = F.replace(pattern, F.lit(plain), F.lit(meant))
    return pattern


def _lookup(value: Column, table: dict[float, float] | None) -> Column:
    out = value
    for stored, nominal in (table or {}).items():
        out = F.when(value == stored, F.lit(nominal)).otherwise(out)
    return out


# Axes in explicit attributes

# The marks of an axis payload and of its forms; axis codes; what a direction to a number of coordinates begins with.
AXIS_HEAD, AXIS_MARK = 5, 2
ONE_COORDINATE, TWO_COORDINATES, PLINE_POINT, DIRECTION_TO = 0x16, 0x17, 0x22, 0x34
AXIS_CODES = {11: "X", 12: "-X", 13: "Y", 14: "-Y", 15: "Z", 16: "-Z"}
POINT_WORDS, SINGLE_AXIS, TO_COUNT = (0x52, 3, 7), 61, {0x1F: 1, 0x20: 2, 0x21: 3}


def _coordinate(words: list[int], negate: bool) -> tuple[str, list[int]]:
    """An axis code, a length and an expression: the text with brackets, and the words after it. negate moves the sign of the axis into the brackets."""
    if len(words) < 3 or words[1] < 2 or len(words) < words[1] + 1:
        raise ExpressionError("a coordinate breaks off")
    axis, n = AXIS_CODES.get(words[0], " "), words[1]
    inside = to_text(tree_of_words(words[3 : n + 1]))
    text = f"{axis[1:]} (NEG ( {inside} )) " if negate and axis.startswith("-") else f"{axis} ( {inside} ) "
    return text, words[n + 1 :]


def axis_text(payload: bytes) -> str | None:
    """The text of an axis of an explicit attribute: one axis, axes with coordinates between them, a point of a p-line, or a direction to coordinates; None for another form."""
    words = list(struct.unpack_from(f">{len(payload) // 4}i", payload))
    if len(words) < AXIS_HEAD:
        return None
    mark, form, rest = words[3], words[4], words[AXIS_HEAD:]
    if mark == AXIS_MARK and form in (ONE_COORDINATE, TWO_COORDINATES):
        parts = []
        for _ in range(1 if form == ONE_COORDINATE else 2):
            text, rest = _coordinate(rest, False)
            parts.append(text)
        if not rest:
            raise ExpressionError("the last axis is missing")
        return ("AXIS " if parts[0].startswith("-") else "") + "".join(parts) + AXIS_CODES.get(rest[0], " ")
    if mark == AXIS_MARK and form == PLINE_POINT:
        return f"PP {rest[3]}" if tuple(rest[:3]) == POINT_WORDS and len(rest) > 3 else None
    if mark == AXIS_MARK and form == DIRECTION_TO:
        if len(rest) < 2 or rest[1] not in TO_COUNT:
            return None
        parts, count, rest = [], TO_COUNT[rest[1]], rest[2:]
        for _ in range(count):
            text, rest = _coordinate(rest, True)
            parts.append(text)
        return "TO " + "".join(parts)
    return AXIS_CODES.get(rest[0]) if len(rest) > 1 and rest[1] == SINGLE_AXIS else None


@F.pandas_udf(T.StringType())
def explicit_axis(payloads: pd.Series) -> pd.Series:
    """axis_text() of payloads; null also for those that break off."""

    def text(payload: object) -> str | None:
        try:
            return None if payload is None else axis_text(bytes(payload))
        except ExpressionError:
            return None

    return payloads.map(text)


# Payloads in rows


def opcode_histogram(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(opcode, n, known): how often each opcode occurs in all payloads; those that are no expression are left out. Counted in Arrow batches before anything moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[tuple[int, bool]] = Counter()
        for batch in batches:
            for value in batch[payload]:
                if value is None:
                    continue
                try:
                    counts, unknown = opcode_counts(bytes(value))
                except ExpressionError:
                    continue
                for opcode, n in counts.items():
                    total[opcode, opcode not in unknown] += n
        yield pd.DataFrame([(o, n, known) for (o, known), n in total.items()], columns=["opcode", "n", "known"])

    found = payloads.select(payload).mapInPandas(count, "opcode int, n bigint, known boolean")
    return found.groupBy("opcode", "known").agg(F.sum("n").alias("n")).select("opcode", "n", "known")


def encode_words(words: list[int]) -> bytes:
    """A payload of the given words; the first one is the empty header word."""
    body = [0, *words]
    return struct.pack(f">{len(body) + 1}i", len(body), *body)
