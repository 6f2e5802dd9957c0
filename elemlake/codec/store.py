"""The page-structured binary store: reading and writing of headers, sessions, index pages and element records.

All numbers are big-endian. A store is a header page and pages of one size.
Every commit appends data pages, index pages and a session page; older
sessions stay readable through their own index root. Writing rebuilds the
index of a session in bulk: entries sorted by key, cut into pages, then a directory level over
them, until one root is left.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from elemlake.functions.names import python_name_hash, python_name_of_hash

# Places of header and session fields, marks and type codes of the format.
HEADER = {"version": 0x04, "db_num": 0x08, "latest_ses_pgno": 0x28, "ext_no": 0x2C, "session_page_no": 0x30, "page_size": 0x34, "stored_page_count": 0x38}
SESSION = {"prev_ses_pgno": 0x04, "sesno": 0x0C, "end_pgno": 0x14, "index_root_pgno": 0x1C, "claim_pgno": 0x24, "year": 0x34, "month": 0x38, "hours": 0x3C, "seconds": 0x40}
NAME_AT, NAME_BYTES = 0x78, 36
PAGE_TYPES = {1: "index", 3: "session", 5: "data", 7: "special", 8: "index"}
INDEX_NOUN, ENTRIES_AT, ENTRY_BYTES = 0xCC47DF, 0x1C, 16
START_MARKER = 0x80000001
PAGE_SIZES = (2048, 4096, 512)
DATA_HEAD = (5, 0x743F11)
RECORD_END = b"\0\0\0\0\0\0\0\7"
EXPLICIT = {15: "string", 10: "string", 6: "doubles", 7: "ints", 16: "element", 4: "element", 3: "int", 5: "bool", 2: "double", 14: "words", 8: "refs"}
EXPLICIT_CODE = {"string": 15, "doubles": 6, "ints": 7, "element": 16, "int": 3, "bool": 5, "double": 2, "refs": 8}

Refno = tuple[int, int]


class StoreError(ValueError):
    """The bytes are no store, page or record of the expected form."""


class ShortError(StoreError):
    """The bytes end inside a record: with more of them it might be one."""


def word(data: bytes, at: int, signed: bool = False) -> int:
    if at < 0 or at + 4 > len(data):
        raise ShortError(f"no word at {at}")
    return struct.unpack_from(">i" if signed else ">I", data, at)[0]


# Texts


def decode_text(raw: bytes) -> str:
    """Text with runs of 7-bit GB2312 pairs between ``&~`` and `` &``; the rest is UTF-8."""
    out, at = [], 0
    raw = raw.rstrip(b"\0")
    while True:
        start = raw.find(b"&~", at)
        if start < 0:
            out.append(raw[at:].decode("utf-8", "replace"))
            return "".join(out)
        out.append(raw[at:start].decode("utf-8", "replace"))
        end = start + 2
        while end + 1 < len(raw) and raw[end : end + 2] != b" &":
            end += 2
        pairs = bytes(b | 0x80 for b in raw[start + 2 : end])
        out.append(pairs.decode("gb2312", "replace"))
        at = min(end + 2, len(raw))


def encode_text(text: str) -> bytes:
    out, pairs = bytearray(), bytearray()

    def close() -> None:
        if pairs:
            out.extend(b"&~" + bytes(b & 0x7F for b in pairs) + b" &")
            pairs.clear()

    for c in text:
        if ord(c) < 128:
            close()
            out += c.encode()
            continue
        try:
            coded = c.encode("gb2312")
        except UnicodeEncodeError:
            coded = b""
        if len(coded) == 2:
            pairs.extend(coded)
        else:
            close()
            out += c.encode("utf-8")
    close()
    return bytes(out)


# Pages


@dataclass
class Session:
    dbnum: int
    sesno: int
    ses_pgno: int
    prev_ses_pgno: int
    end_pgno: int
    index_root_pgno: int
    claim_pgno: int
    ts: datetime | None
    computer_name: str
    comments: str
    first_pgno: int = 0

    def violations(self) -> list[str]:
        rules = {"sesno": self.sesno > 0, "end_pgno": self.end_pgno > 0, "index_root_pgno": self.index_root_pgno > 0, "prev_ses_pgno": self.prev_ses_pgno < self.ses_pgno}
        return [name for name, holds in rules.items() if not holds]


@dataclass(frozen=True)
class Entry:
    level: int
    page: int
    ord: int
    ref0: int
    ref1: int
    child_pgno: int
    offset_words: int
    flag: int


def read_header(data: bytes) -> dict[str, int]:
    return {name: word(data, at) for name, at in HEADER.items()}


def probe_page_size(read: Callable[[int, int], bytes], header: dict[str, int]) -> int:
    """The size at which the named pages are session pages; the header's own claim is not trusted."""
    for size in PAGE_SIZES:
        for page in (header["session_page_no"], header["latest_ses_pgno"]):
            start = read(page * size, 4)
            if page and len(start) == 4 and word(start, 0) == 3:
                return size
    return PAGE_SIZES[0]


def session_time(year: int, month: int, hours: int, seconds: int) -> datetime | None:
    """Day and hour share one field, minute and second another; an impossible date is none."""
    try:
        return datetime(year, month, hours // 24, hours % 24, seconds // 60, seconds % 60)
    except ValueError:
        return None


def read_session(page: bytes, dbnum: int, pgno: int) -> Session:
    if word(page, 0) != 3:
        raise StoreError(f"page {pgno} is no session page")
    f = {name: word(page, at) for name, at in SESSION.items()}
    size = word(page, NAME_AT)
    name = page[NAME_AT + 4 : NAME_AT + 4 + min(size * 4, NAME_BYTES)]
    comment_at = NAME_AT + 4 + NAME_BYTES
    comment = page[comment_at + 4 : comment_at + 4 + word(page, comment_at) * 4]
    return Session(dbnum, f["sesno"], pgno, f["prev_ses_pgno"], f["end_pgno"], f["index_root_pgno"], f["claim_pgno"], session_time(f["year"], f["month"], f["hours"], f["seconds"]), decode_text(name), decode_text(comment))


def read_entries(page: bytes, pgno: int) -> list[Entry]:
    """Entries up to the first zero word; the declared count is not trusted."""
    if word(page, 0) not in (1, 8) or word(page, 4) != INDEX_NOUN:
        raise StoreError(f"page {pgno} is no index page")
    level, out = word(page, 8), []
    for i, at in enumerate(range(ENTRIES_AT, len(page) - ENTRY_BYTES + 1, ENTRY_BYTES)):
        ref0, ref1, child, packed = struct.unpack_from(">4I", page, at)
        if ref0 == 0:
            break
        out.append(Entry(level, pgno, i, ref0, ref1, child, packed >> 12, packed & 0xFFF))
    return out


class Store:
    """Random access to one store through read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        self.header = read_header(read(0, 64))
        self.page_size = probe_page_size(read, self.header)

    def page(self, pgno: int) -> bytes:
        return self.read(pgno * self.page_size, self.page_size)

    def sessions(self) -> list[Session]:
        """The chain from the newest session back, oldest first, with page ranges; a chain that bites its tail ends there."""
        found, seen, pgno = [], set(), self.header["latest_ses_pgno"] or self.header["session_page_no"]
        while pgno and pgno not in seen:
            seen.add(pgno)
            try:
                session = read_session(self.page(pgno), self.header["db_num"], pgno)
            except StoreError:
                break
            found.append(session)
            pgno = session.prev_ses_pgno
        found.reverse()
        for last, session in zip(found, found[1:]):
            session.first_pgno = last.end_pgno + 1
        return found

    def entries(self, root: int, strict: bool = False, least_page: int = 0) -> Iterator[Entry]:
        """All entries below a root, each page once; pages that cannot be read are passed over, or an error if strict. A start marker leads to what lies left of its page's first key.

        Pages before least_page are not opened: stores only grow, so nothing in them or below leads to a later page.
        """
        waiting, seen = [root], set()
        while waiting:
            pgno = waiting.pop()
            if not pgno or pgno in seen or pgno < least_page:
                continue
            seen.add(pgno)
            try:
                rows = read_entries(self.page(pgno), pgno)
            except StoreError:
                if strict:
                    raise
                continue
            for e in rows:
                yield e
                if e.level > 0:
                    waiting.append(e.child_pgno)

    def cut(self, sessions: list[Session]) -> int:
        """The page before the oldest of the sessions found if it cannot be read, else 0."""
        before = sessions[0].prev_ses_pgno if sessions else self.header["latest_ses_pgno"] or self.header["session_page_no"]
        return 0 if before in {s.ses_pgno for s in sessions} else before

    def damage(self) -> list[int]:
        """Pages that the header, the chain of sessions or an index names and that cannot be read as such."""
        sessions = self.sessions()
        bad = {self.cut(sessions)} - {0}
        waiting, seen = [s.index_root_pgno for s in sessions], set()
        while waiting:
            pgno = waiting.pop()
            if not pgno or pgno in seen:
                continue
            seen.add(pgno)
            try:
                waiting += [e.child_pgno for e in read_entries(self.page(pgno), pgno) if e.level > 0]
            except StoreError:
                bad.add(pgno)
        return sorted(bad)

    def known_ref0s(self, bytes_: int) -> set[int]:
        """The first halves of all keys in the leaf pages of the file, whether a root leads to them or not."""
        found = set()
        for pgno in range(1, bytes_ // self.page_size):
            try:
                found |= {e.ref0 for e in read_entries(self.page(pgno), pgno) if e.level == 0}
            except StoreError:
                continue
        return found - {0, START_MARKER}

    def scan(self, ref0s: set[int], start: int, end: int, layouts: "Layouts | None" = None) -> Iterator[tuple[int, "Element"]]:
        """Records that begin in [start, end), found by their words; they may end beyond it."""
        data = self.read(start, end - start + 16)
        marks = re.compile(rb"(?=\0\0\0[\x06-\xff](?:" + b"|".join(re.escape(struct.pack(">I", r)) for r in sorted(ref0s)) + b"))", re.DOTALL)
        for m in marks.finditer(data):
            at = m.start()
            if (start + at) % 2 or start + at >= end or at + 16 > len(data) or not word(data, at + 8) or not python_name_of_hash(word(data, at + 12)):
                continue
            try:
                yield start + at, self.record(start + at, layouts)
            except (StoreError, struct.error):
                continue

    def address(self, e: Entry) -> int:
        return e.child_pgno * self.page_size + e.offset_words * 2

    def newest(self, root: int, strict: bool = False, least_page: int = 0) -> dict[Refno, Entry]:
        """Leaf entry of every key; of several the one furthest back in the store wins. With least_page, of those that point there or later."""
        out: dict[Refno, Entry] = {}
        for e in self.entries(root, strict, least_page):
            key = (e.ref0, e.ref1)
            if e.level == 0 and key != (START_MARKER, START_MARKER) and (key not in out or self.address(e) > self.address(out[key])):
                out[key] = e
        return out

    def find(self, root: int, key: Refno) -> Entry | None:
        """Point lookup: down the last child whose key is not greater (a start marker is less than any)."""
        pgno, seen = root, set()
        while pgno not in seen:
            seen.add(pgno)
            rows = read_entries(self.page(pgno), pgno)
            if not rows:
                return None
            if rows[0].level == 0:
                hits = [e for e in rows if (e.ref0, e.ref1) == key]
                return max(hits, key=self.address, default=None)
            left = [e for e in rows if (e.ref0, e.ref1) == (START_MARKER, START_MARKER) or (e.ref0, e.ref1) <= key]
            pgno = (left[-1] if left else rows[0]).child_pgno
        return None

    def record(self, at: int, layouts: "Layouts | None" = None) -> "Element":
        """The element at an address, whatever its length: while it goes on beyond the bytes read, twice as many are."""
        window = 1 << 12
        while True:
            data = self.read(at, window)
            try:
                return read_element(data, layouts)
            except ShortError:
                if len(data) < window:
                    raise
                window *= 2


# Elements


@dataclass
class Element:
    refno: Refno
    noun: str
    owner: Refno
    children: list[Refno] = field(default_factory=list)
    attrs: dict[str, tuple[str, object]] = field(default_factory=dict)  # name: (type, value)
    length: int = 0


def _explicit_value(kind: str, payload: bytes) -> object:
    n = len(payload) // 4
    if kind == "string":
        size = word(payload, 0)
        return decode_text(payload[4 : 4 + size])
    if kind == "int":
        return word(payload, 0, True)
    if kind == "bool":
        return word(payload, 0) != 0
    if kind == "double":
        return struct.unpack_from(">d", payload)[0]
    if kind == "doubles":
        return list(struct.unpack_from(f">{n // 2}d", payload))
    if kind in ("ints", "words"):
        return list(struct.unpack_from(f">{n}i", payload))
    flat = struct.unpack_from(f">{n}I", payload)
    refs = list(zip(flat[::2], flat[1::2]))
    return refs[0] if kind == "element" and refs else refs


@dataclass(frozen=True)
class Place:
    """Where the fixed part of a noun's records has an attribute: name, first word, bit, type and whether it holds an expression."""

    attr: str
    word: int
    bit: int
    kind: str
    is_expr: bool = False


Layouts = dict[str, list[Place]]  # by noun

# Words that a type takes with reals of two words, how many of them are saved with reals of one, and the block flags.
WIDTH, SAVED = {"Position": 6, "Reference": 2}, {"Real": 1, "Position": 3}
EXPLICIT_FLAG, CHILDREN_FLAG = 1, 2
MOST_PADDING = 4096  # bytes
FIXED_WORDS, BLOCK_HEAD, SEGMENT_HEAD, MOST_BLOCK_WORDS = 6, 12, 24, 0xFFFF


def _places(layout: list[Place], impl_words: int) -> tuple[bool, list[tuple[Place, int]]]:
    """Whether the record has reals of one word, and the word at which each attribute stands in it.

    It has if the last attribute would otherwise end behind the fixed part; every real before an attribute then moves it forward.
    """
    order = sorted(layout, key=lambda p: (p.word, p.bit))
    short = bool(order) and order[-1].word + WIDTH.get(order[-1].kind, 1) > impl_words
    out, saved = [], 0
    for p in order:
        out.append((p, p.word - saved if short else p.word))
        if not p.is_expr:
            saved += SAVED.get(p.kind, 0)
    return short, out


def read_implicit(data: bytes, layout: list[Place]) -> dict[str, tuple[str, object]]:
    """The attributes of the fixed part of a record; those that lie outside it are not there."""
    words = word(data, 0)
    short, places = _places(layout, words)
    real, size = (">f", 4) if short else (">d", 8)
    out: dict[str, tuple[str, object]] = {}
    for p, at in places:
        start, end = at * 4, words * 4
        width = size if p.kind == "Real" else 3 * size if p.kind == "Position" else 8 if p.kind == "Reference" else 4
        if at < FIXED_WORDS or start + width > min(end, len(data)) or p.is_expr:
            continue
        if p.kind == "Real":
            out[p.attr] = ("double", struct.unpack_from(real, data, start)[0])
        elif p.kind == "Position":
            out[p.attr] = ("doubles", list(struct.unpack_from(f">3{real[1]}", data, start)))
        elif p.kind == "Reference":
            out[p.attr] = ("element", struct.unpack_from(">2I", data, start))
        elif p.kind == "Boolean":
            out[p.attr] = ("bool", word(data, start) >> max(p.bit, 0) & 1 == 1)
        elif p.kind == "Enum":
            number = word(data, start, True)
            out[p.attr] = ("string", python_name_of_hash(abs(number)) or str(number))
        elif p.kind == "Text":
            value = _implicit_text(data[start:end])
            # An empty tolerance or quantity says 0.
            out[p.attr] = ("string", "0" if not value and p.attr in ("MTOL", "MTOQ") else value)
        else:
            out[p.attr] = ("int", word(data, start, True))
    return out


def _implicit_text(data: bytes) -> str:
    """Text behind its length: bytes one after another, or a character a word."""
    size = max(word(data, 0, True), 0)
    if size and len(data) > 4 and data[4]:
        return decode_text(data[4 : 4 + size])
    return bytes(data[7 : 4 + 4 * size : 4]).decode("latin-1")


def write_implicit(values: dict[str, object], layout: list[Place], short: bool = False) -> bytes:
    """The words behind the fixed head, as read_implicit() reads them; text must be the last attribute or fit before the next."""
    order = sorted(layout, key=lambda p: (p.word, p.bit))
    full = max((p.word + WIDTH.get(p.kind, 2 if p.kind == "Real" else 1) for p in order), default=FIXED_WORDS)
    short_places = _places(layout, 0)[1] if order else []
    places = [(p, at) for p, at in short_places] if short else [(p, p.word) for p in order]
    texts = [at + 2 + len(encode_text(str(values[p.attr]))) // 4 for p, at in places if p.kind == "Text" and p.attr in values]
    words = max([(max((at + (3 if p.kind == "Position" else 2 if p.kind == "Reference" else 1) for p, at in places), default=FIXED_WORDS)) if short else full, *texts])
    data = bytearray(words * 4)
    real = ">f" if short else ">d"
    for p, at in places:
        if p.attr not in values:
            continue
        value, start = values[p.attr], at * 4
        if p.kind == "Real":
            struct.pack_into(real, data, start, value)
        elif p.kind == "Position":
            struct.pack_into(f">3{real[1]}", data, start, *value)
        elif p.kind == "Reference":
            struct.pack_into(">2I", data, start, *value)
        elif p.kind == "Boolean":
            struct.pack_into(">I", data, start, word(data, start) | int(value) << max(p.bit, 0))
        elif p.kind == "Enum":
            struct.pack_into(">i", data, start, python_name_hash(value))
        elif p.kind == "Text":
            raw = encode_text(value)
            struct.pack_into(f">i{len(raw)}s", data, start, len(raw), raw)
        else:
            struct.pack_into(">i", data, start, value)
    return bytes(data[FIXED_WORDS * 4 :])


def _segmented(data: bytes, at: int, flag: int) -> tuple[bytes, int]:
    """The payload of the block at an address, its further segments included, and where it ends."""
    end = at + 4 * struct.unpack_from(">H", data, at + 2)[0]
    if end > len(data):
        raise ShortError("a block ends outside the bytes read")
    parts = [data[at + BLOCK_HEAD : end]]
    while data[end : end + 6] == b"\0\0\0\7\0" + bytes([flag]):
        if end + 8 > len(data):
            raise ShortError("a segment begins outside the bytes read")
        after = end + 4 + 4 * struct.unpack_from(">H", data, end + 6)[0]
        if after < end + SEGMENT_HEAD:
            raise StoreError("a segment is shorter than its head")
        if after > len(data):
            raise ShortError("a segment ends outside the bytes read")
        parts.append(data[end + SEGMENT_HEAD : after])
        end = after
    if len(data) < end + 6 and data[end:].startswith(b"\0\0\0\7"[: len(data) - end]):
        raise ShortError("whether a segment follows is outside the bytes read")
    return b"".join(parts), end


def _entry(data: bytes, at: int) -> tuple[str, tuple[str, object], int]:
    hashed, packed = word(data, at, True), word(data, at + 4)
    kind, size = EXPLICIT.get(packed >> 26), (packed & 0x3FFFFFF) * 4
    if kind is None:
        raise StoreError(f"{packed >> 26} is no type of an attribute")
    if at + 8 + size > len(data):
        raise ShortError("an attribute ends outside the bytes read")
    name = python_name_of_hash(abs(hashed)) or f"HASH_{hashed}"
    return name if hashed > 0 else f":{name}", (kind, _explicit_value(kind, data[at + 8 : at + 8 + size])), at + 8 + size


def read_element(data: bytes, layouts: Layouts | None = None) -> Element:
    """A record: padding, the fixed part, blocks of children and of attributes in any number of segments, or attributes without a block, up to the end mark."""
    start = 0
    while start + 4 <= len(data) and word(data, start) in (0, 7):  # padding before a record
        start += 4
    impl = word(data, start) * 4
    if impl < 24:
        raise StoreError("a record is shorter than its fixed part")
    refno = word(data, start + 4), word(data, start + 8)
    element = Element(refno, python_name_of_hash(word(data, start + 12)) or f"HASH_{word(data, start + 12)}", (word(data, start + 16), word(data, start + 20)))
    at = start + impl
    if at + 8 > len(data):
        raise ShortError("the record ends outside the bytes read")
    if layouts and element.noun in layouts:
        element.attrs |= read_implicit(data[start:at], layouts[element.noun])
    own, body, blank = data[start + 4 : start + 12], at, 0
    # Zeros and marks right behind the fixed part are padding if a block of this element follows them.
    ahead = at
    while ahead + 4 <= min(len(data), at + 64) and word(data, ahead) in (0, 7):
        ahead += 4
    if data[ahead : ahead + 1] == b"\0" and data[ahead + 1 : ahead + 2] in (b"\1", b"\2") and data[ahead + 4 : ahead + 12] == own:
        at = body = ahead
    while data[at : at + 8] != RECORD_END:
        mark = word(data, at)
        if mark == 7 and blank < at - body:  # behind a block, a mark that begins no segment ends the record as well
            element.length = at + 4
            return element
        if mark == 0 or mark == 7:  # padding between the parts
            at, blank = at + 4, blank + 4
            if blank > MOST_PADDING:
                raise StoreError("padding without end")
        elif len(data) < at + 12:
            raise ShortError("a block begins outside the bytes read")
        elif mark >> 16 in (EXPLICIT_FLAG, CHILDREN_FLAG) and mark & 0xFFFF >= 3 and data[at + 4 : at + 12] == own:
            flag = mark >> 16
            payload, at = _segmented(data, at, flag)
            if flag == CHILDREN_FLAG:
                flat = struct.unpack_from(f">{len(payload) // 8 * 2}I", payload)
                element.children += zip(flat[::2], flat[1::2])
                continue
            inside = 0
            try:
                while inside < len(payload):
                    name, value, inside = _entry(payload, inside)
                    element.attrs[name] = value
            except ShortError as e:
                raise StoreError(f"a block breaks off: {e}") from None
        else:
            name, value, at = _entry(data, at)
            element.attrs[name] = value
        if at + 8 > len(data):
            raise ShortError("the record ends outside the bytes read")
    element.length = at + 8
    return element


def _block(flag: int, refno: Refno, payload: bytes, most_words: int) -> bytes:
    """A block and, where it has more words than it may, segments after it."""
    first = (most_words - BLOCK_HEAD // 4) * 4
    out = bytearray(struct.pack(">HH2I", flag, (BLOCK_HEAD + len(payload[:first])) // 4, *refno) + payload[:first])
    each = (most_words - (SEGMENT_HEAD - 4) // 4) * 4
    for at in range(first, len(payload), each):
        part = payload[at : at + each]
        out += struct.pack(">IHH4I", 7, flag, (SEGMENT_HEAD - 4 + len(part)) // 4, *refno, 0, 0) + part
    return bytes(out)


def write_element(element: Element, layouts: Layouts | None = None, most_words: int = MOST_BLOCK_WORDS, short: bool = False) -> bytes:
    """A record: attributes that the noun's layout places in the fixed part, children and the other attributes in blocks of at most most_words words.

    User attributes (``:NAME``) are stored under their negated hash.
    """
    layout = (layouts or {}).get(element.noun, [])
    placed = {p.attr for p in layout if not p.is_expr}
    fixed = write_implicit({k: v for k, (_, v) in element.attrs.items() if k in placed}, layout, short) if layout else b""
    out = bytearray(struct.pack(">6I", FIXED_WORDS + len(fixed) // 4, *element.refno, python_name_hash(element.noun), *element.owner)) + fixed
    if element.children:
        out += _block(CHILDREN_FLAG, element.refno, b"".join(struct.pack(">2I", *c) for c in element.children), most_words)
    entries = bytearray()
    for name, (kind, value) in element.attrs.items():
        if name in placed:
            continue
        payload = _explicit_payload(kind, value)
        hashed = -python_name_hash(name[1:]) if name.startswith(":") else python_name_hash(name)
        entries += struct.pack(">iI", hashed, EXPLICIT_CODE[kind] << 26 | len(payload) // 4) + payload
    if entries:
        out += _block(EXPLICIT_FLAG, element.refno, bytes(entries), most_words)
    return bytes(out) + RECORD_END


def _explicit_payload(kind: str, value: object) -> bytes:
    if kind == "string":
        raw = encode_text(value)
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)
    if kind in ("int", "bool"):
        return struct.pack(">i", int(value))
    if kind == "double":
        return struct.pack(">d", value)
    if kind == "doubles":
        return struct.pack(f">{len(value)}d", *value)
    if kind == "ints":
        return struct.pack(f">{len(value)}i", *value)
    refs = [value] if kind == "element" else value
    return b"".join(struct.pack(">2I", *r) for r in refs)


# Writing


class Writer:
    """Builds a store commit by commit; bytes() gives what is written so far."""

    def __init__(self, dbnum: int, page_size: int = 2048):
        self.dbnum, self.page_size, self.layouts = dbnum, page_size, None
        self.data = bytearray(page_size)
        self.places: dict[Refno, tuple[int, int]] = {}
        self.last_session = 0

    @property
    def pages(self) -> int:
        return len(self.data) // self.page_size

    def _fill(self) -> None:
        self.data += b"\0" * (-len(self.data) % self.page_size)

    def _index(self, rows: list[tuple[int, int, int, int, int]]) -> int:
        """Index pages over sorted (ref0, ref1, page, offset, flag); returns the root."""
        each, level = (self.page_size - ENTRIES_AT) // ENTRY_BYTES - 1, 0
        while True:
            above = []
            for i in range(0, max(len(rows), 1), each):
                lot = rows[i : i + each]
                page = bytearray(struct.pack(">7I", 1, INDEX_NOUN, level, len(lot), 0, 0, 0))
                for ref0, ref1, child, offset, flag in lot:
                    page += struct.pack(">4I", ref0, ref1, child, offset << 12 | flag)
                pgno = self.pages
                self.data += page + b"\0" * (self.page_size - len(page))
                first = (START_MARKER, START_MARKER) if i == 0 else lot[0][:2]
                above.append((*first, pgno, 0, 0))
            if len(above) == 1:
                return above[0][2]
            rows, level = above, level + 1

    def commit(self, sesno: int, elements: list[Element], removed: tuple[Refno, ...] = (), ts: datetime | None = None, computer: str = "", comment: str = "") -> None:
        self._fill()
        touched = set()
        for e in elements:
            # A record starts at an even byte of its page; offsets count half words and have 20 bits.
            if len(self.data) % self.page_size == 0:  # offset 0 is the page's own head
                self.data += struct.pack(">2I", *DATA_HEAD)
            at = len(self.data)
            self.places[e.refno] = (at // self.page_size, at % self.page_size // 2)
            touched.add(e.refno)
            self.data += write_element(e, self.layouts)
        self._fill()
        for key in removed:
            self.places.pop(key, None)
        root = self._index([(*k, *self.places[k], 1 if k in touched else 0) for k in sorted(self.places)])
        pgno = self.pages
        page = bytearray(self.page_size)
        when = ts or datetime(2020, 1, 1)
        fields = {"prev_ses_pgno": self.last_session, "sesno": sesno, "end_pgno": pgno, "index_root_pgno": root, "claim_pgno": 0, "year": when.year, "month": when.month, "hours": when.day * 24 + when.hour, "seconds": when.minute * 60 + when.second}
        struct.pack_into(">I", page, 0, 3)
        struct.pack_into(">i", page, 0x10, -1)
        for name, value in fields.items():
            struct.pack_into(">I", page, SESSION[name], value)
        comment_at = NAME_AT + 4 + NAME_BYTES
        for at, text, most in ((NAME_AT, computer, NAME_BYTES), (comment_at, comment, self.page_size - comment_at - 4)):
            raw = encode_text(text)[:most]
            struct.pack_into(">I", page, at, -(-len(raw) // 4))
            page[at + 4 : at + 4 + len(raw)] = raw
        self.data += page
        self.last_session = pgno
        for name, value in {"version": 2, "db_num": self.dbnum, "latest_ses_pgno": pgno, "ext_no": 1, "session_page_no": pgno, "page_size": self.page_size, "stored_page_count": self.pages}.items():
            struct.pack_into(">I", self.data, HEADER[name], value)

    def bytes(self) -> bytes:
        return bytes(self.data)


def store_of_bytes(data: bytes) -> Store:
    return Store(lambda at, n: data[at : at + n])


def scan_records(data: bytes, ref0s: set[int], start: int, end: int) -> Iterator[tuple[int, Element]]:
    """Records found without the index, in bytes at hand."""
    return store_of_bytes(data).scan(ref0s, start, end)
