"""One consistent form for texts that look the same.

Characters are first folded one by one: any space is a space, any hyphen a
hyphen, width does not matter, joined letters are their letters, characters
that print nothing go, accents are taken off their letters. Then each token's scripts are
resolved: a letter drawn alike in several alphabets could belong to any of
them, another only to its own, and the intersection over the token's letters
tells how it can be spelled consistently. A token that no single script covers as
it is written, but one could, is a mixed-script confusable; one that a single script covers
but that an alphabet preferred to it could spell as well is a whole-script
confusable. Scripts that are written together (Chinese characters with Japanese syllables, Korean
or Bopomofo) are one script here; signs common to all scripts decide nothing. The
token is spelled in the first script of the intersection, in a fixed order;
if it is empty, each look-alike takes the first alphabet that has it. Last, accents
are put back.

That spelling depends only on what the token looks like, so two texts have
the same form exactly if they look the same in this sense. Letters and
digits of one alphabet are never identified, but for a few that are one letter in two codes.

Defined results: a null text has no form and is in no pair; empty texts are
equal, and look like texts of characters that print nothing; documents
without id are in no pair; of repeated rows of one document each text counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elemlake.plans.workspace import written

# Letters drawn alike, a class a column, an alphabet a row; a dot where an alphabet has none.
LOOK_ALIKES = {
    "Latin":    "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z a b c d e g h i j l n o p q s u v w x y",
    "Cyrillic": "А В С . Е . Ԍ Н І Ј К . М . О Р Ԛ . Ѕ Т . Ѵ Ԝ Х Ү . а . с ԁ е . һ і ј ӏ . о р ԛ ѕ . ѵ ԝ х у",
    "Greek":    "Α Β Ϲ . Ε Ϝ . Η Ι Ϳ Κ . Μ Ν Ο Ρ . . . Τ . . . Χ Υ Ζ . . ϲ . . . . . ϳ . . ο ρ . . . ν . . .",
    "Armenian": ". . . . . . . . . . . . . . Օ . . . Տ . Ս . . . . . . . . . . ց հ . յ . ո օ . զ . ս . . . .",
    "Coptic":   ". Ⲃ Ⲥ . . . . Ⲏ Ⲓ . Ⲕ . Ⲙ Ⲛ Ⲟ Ⲣ . . . Ⲧ . . . Ⲭ Ⲩ Ⲍ . . ⲥ . . . . . . . . ⲟ ⲣ . . . . . ⲭ .",
    "Cherokee": "Ꭺ Ᏼ Ꮯ Ꭰ Ꭼ . Ꮐ Ꮋ . Ꭻ Ꮶ Ꮮ Ꮇ . . Ꮲ . Ꭱ Ꮪ Ꭲ . Ꮩ Ꮃ . Ꮍ Ꮓ . Ꮟ . Ꮷ . . . Ꭵ . . . . . . . . . . . Ꭹ",
    "Lisu":     "ꓮ ꓐ ꓚ ꓓ ꓰ ꓝ ꓖ ꓧ ꓲ ꓙ ꓗ ꓡ ꓟ ꓠ ꓳ ꓑ . ꓣ ꓢ ꓔ ꓴ ꓦ ꓪ ꓫ ꓬ ꓜ . . . . . . . . . . . . . . . . . . . .",
}
# Further codes of letters above, in their own alphabet; the order in which alphabets are preferred; hyphens; fillers that print nothing; line breaks.
SAME_LETTER = {"Ӏ": "І", "ɡ": "g"}
PREFERRED = ("Latin", "Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee", "Lisu")
HYPHENS = "\u002d\u058a\u2010\u2011\u2043\ufe63\uff0d"
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
LINE_BREAKS = "\u000b\u000c\u000d\u0085\u2028\u2029"
# Scripts by the first words of a letter's name where that is not its script's own name, and the writing systems that use several scripts.
NAMED = {"Cjk": "Han", "Katakana-hiragana": "Common", "Modifier": "Common", "Micro": "Common", "Feminine": "Common", "Masculine": "Common", "?": "Unknown"}
WRITTEN_TOGETHER = {"Han": ("Japanese", "Korean", "Bopomofo-Han"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Bopomofo-Han",)}

_SPELLING = {script: row.split() for script, row in LOOK_ALIKES.items()}
_CLASS_OF = {c: i for row in _SPELLING.values() for i, c in enumerate(row) if c != "."}
_CLASS_OF |= {c: _CLASS_OF[known] for c, known in SAME_LETTER.items() if known in _CLASS_OF}
_SCRIPTS = [frozenset(s for s in PREFERRED if _SPELLING[s][i] != ".") for i in range(len(_SPELLING["Latin"]))]


def script_of(letter: str) -> str:
    """The alphabet in a letter's name: its first word, or Common if it belongs to none."""
    first = unicodedata.name(letter, "?").split()[0].capitalize()
    return NAMED.get(first, first)


def scripts_of(letter: str) -> frozenset[str] | None:
    """The scripts a letter is written in, with the systems that use several; None if it may stand in any."""
    own = script_of(letter)
    return None if own == "Common" else frozenset((own, *WRITTEN_TOGETHER.get(own, ())))


def fold_character(c: str) -> str:
    """What a character shows, apart from its alphabet."""
    kind = unicodedata.category(c)
    if c in "\n" or c in LINE_BREAKS:
        return "\n"
    if kind == "Zs" or c == "\t":
        return " "
    if c in HYPHENS:
        return "-"
    if kind in ("Cf", "Cc") or c in FILLERS or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    tag, _, points = unicodedata.decomposition(c).rpartition("> ")
    if not tag:
        return c
    shown = "".join(chr(int(p, 16)) for p in points.split())
    # Widths and fonts change no letter; joined letters are letters joined; other compatible forms (raised, circled, fractions, symbol variants) look different.
    if tag in ("<wide", "<narrow", "<font", "<noBreak", "<initial", "<medial", "<final", "<isolated"):
        return "".join(map(fold_character, shown))
    joined = len(shown) > 1 or kind == "Nl" or c == "\u00b5"
    if tag == "<compat" and joined and kind in ("Ll", "Lu", "Lt", "Nl") and all(unicodedata.category(x)[0] == "L" for x in shown):
        return "".join(map(fold_character, shown))
    return c


class _Folds(dict):
    """str.translate() table that fills itself."""

    def __missing__(self, point: int) -> str:
        self[point] = out = fold_character(chr(point))
        return out


_FOLDS = _Folds()
_PLAIN = re.compile(r"[\x20-\x7e\n]*")
_TOKEN = re.compile(r"[\w\u0300-\u036f]+")
# Where the alphabets above but Latin have their letters; a text without any is spelled consistently.
_FOREIGN = re.compile(r"[\u0261\u0370-\u058f\u13a0-\u13ff\u1c80-\u1c8f\u2c80-\u2cff\u2de0-\u2dff\ua4d0-\ua4ff\ua640-\ua69f\uab70-\uabbf]")
_MOST_TOKENS = 1 << 17


def resolved_scripts(token: str) -> tuple[frozenset[str], frozenset[str]]:
    """The scripts a token could be spelled in, and those that cover it as it is written. Accents, digits and common signs belong to any."""
    possible: frozenset[str] | None = None
    covering: frozenset[str] | None = None
    for c in token:
        if unicodedata.category(c)[0] != "L":
            continue
        own = scripts_of(c)
        if own is not None:
            covering = own if covering is None else covering & own
        can = _SCRIPTS[_CLASS_OF[c]] if c in _CLASS_OF else own
        if can is not None:
            possible = can if possible is None else possible & can
    return possible or frozenset(), covering if covering is not None else frozenset(PREFERRED)


def consistent_token(token: str) -> str:
    possible, _ = resolved_scripts(token)
    script = next((s for s in PREFERRED if s in possible), None)
    if script is None:
        return "".join(next(x for x in (_SPELLING[s][_CLASS_OF[c]] for s in PREFERRED) if x != ".") if c in _CLASS_OF else c for c in token)
    row = _SPELLING[script]
    return "".join(row[_CLASS_OF[c]] if c in _CLASS_OF else c for c in token)


def confusable_kind(token: str) -> str:
    """mixed, whole or none, for a folded token."""
    possible, covering = resolved_scripts(token)
    if not covering:
        return "mixed" if possible else "none"
    preferred = next((s for s in PREFERRED if s in possible), None)
    return "none" if preferred is None or preferred in covering else "whole"


def folded(text: str) -> str:
    return unicodedata.normalize("NFD", text.replace("\r\n", "\n").translate(_FOLDS))


def consistent_text(text: str, known: dict[str, str] | None = None) -> str:
    """The consistent form of a text; linear in its length. known keeps tokens seen before."""
    if _PLAIN.fullmatch(text):
        return text
    out = folded(text)
    if _FOREIGN.search(out):
        known = {} if known is None else known

        def spell(m: re.Match) -> str:
            token = m.group()
            if token.isascii():
                return token
            form = known.get(token)
            if form is None:
                if len(known) >= _MOST_TOKENS:
                    known.clear()
                form = known[token] = consistent_token(token)
            return form

        out = _TOKEN.sub(spell, out)
    return unicodedata.normalize("NFC", out)


@F.pandas_udf(T.StringType())
def consistent_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for texts in batches:
        yield pd.Series([None if t is None else consistent_text(t, known) for t in texts], dtype="object")


@F.pandas_udf(T.BinaryType())
def form_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """128-bit hash of the consistent form, so that texts need not travel back."""
    from xxhash import xxh3_128_digest

    known: dict[str, str] = {}
    for texts in batches:
        yield pd.Series([None if t is None else xxh3_128_digest(consistent_text(t, known).encode("utf-8", "surrogatepass")) for t in texts], dtype="object")


@F.pandas_udf(T.StructType([T.StructField("mixed", T.IntegerType()), T.StructField("whole", T.IntegerType())]))
def confusable_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Tokens of a text that are mixed-script and whole-script confusables; a word of Latin letters is neither, accents or not."""
    known: dict[str, str] = {}
    for texts in batches:
        rows = []
        for t in texts:
            count = {"mixed": 0, "whole": 0, "none": 0}
            if t and not t.isascii():
                for m in _TOKEN.finditer(folded(t)):
                    token = m.group()
                    if token.isascii():
                        continue
                    kind = known.get(token)
                    if kind is None:
                        if len(known) >= _MOST_TOKENS:
                            known.clear()
                        kind = known[token] = confusable_kind(token)
                    count[kind] += 1
            rows.append((count["mixed"], count["whole"]))
        yield pd.DataFrame(rows, columns=["mixed", "whole"]).astype("int32")


def look_alike_members(documents: DataFrame) -> DataFrame:
    """(doc_id, form, spelling) of the documents whose look is written in several ways; form and spelling are hashes."""
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", form_key("text").alias("form"), F.xxhash64("text").alias("spelling"))
    keyed = written(rows, "forms")
    # Least and greatest spelling are combined before the shuffle: a form that a third of all documents have costs one row a task.
    several = keyed.groupBy("form").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low != high").select("form")
    return keyed.join(several, "form").distinct()


def look_alike_pairs(documents: DataFrame, per_salt: int = 5_000) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents that look the same but differ in characters.

    Spellings of one form are paired first and documents attached to them, so
    exact copies are never compared and the work is that of the output. Of a form that many documents have, one
    side is dealt to salts, per_salt documents each, and the other sent to all of them.
    """
    members = written(look_alike_members(documents), "look-alikes")
    sized = members.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("n"))
    salts = sized.groupBy("form").agg((F.sum("n") / per_salt).cast("int").alias("last_salt"))
    spellings = sized.select("form", "spelling")
    other = spellings.select("form", F.col("spelling").alias("spelling_b"))
    ways = spellings.withColumnRenamed("spelling", "spelling_a").join(other, "form").where("spelling_a != spelling_b")
    spread = members.join(salts, "form")
    left = spread.select("form", F.col("spelling").alias("spelling_a"), F.col("doc_id").alias("doc_id_a"), F.pmod(F.xxhash64("doc_id"), F.col("last_salt") + 1).cast("int").alias("salt"))
    right = spread.select("form", F.col("spelling").alias("spelling_b"), F.col("doc_id").alias("doc_id_b"), F.explode(F.sequence(F.lit(0), "last_salt")).alias("salt"))
    return left.join(ways, ["form", "spelling_a"]).join(right, ["form", "spelling_b", "salt"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """A row per document that has look-alikes: (doc_id, class_id, n_documents, n_spellings); class_id is the least id of the class."""
    members = written(look_alike_members(documents), "look-alikes")
    spellings = members.select("form", "spelling").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n_spellings"))
    classes = members.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_documents")).join(spellings, "form")
    return members.join(classes, "form").select("doc_id", "class_id", "n_documents", "n_spellings")
