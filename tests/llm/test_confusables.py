from __future__ import annotations

import itertools
import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from elemlake.llm.confusables import LOOK_ALIKES, confusable_kind, confusable_tokens, consistent_text, folded, look_alike_classes, look_alike_pairs, resolved_scripts, script_of


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("paper", "раper"), ("сор", "cop"), ("Tοm", "Tom"), ("naïve", "naïve"), ("йод", "йод"), ("ёлка", "ëлка"), ("ABC１２", "ＡＢＣ12"), ("ﬁn ﬂy oﬃce", "fin fly office"),
        ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"), ("ab", "﻿ab"), ("a-b", "a‐b"), ("a-b", "a‑b"), ("4K", "4K"), ("", "‍"), ("a\nb", "a\r\nb"), ("Ⅳ", "IV"), ("ΝΟΤΕ", "NOTE"), ("э́c", "э́с"),
        ("Ӏvan", "Ivan"), ("ѴI", "VI"), ("Ԛ", "Q"), ("ԜEST", "WEST"), ("ԌAS", "GAS"), ("ոս", "nu"), ("ցag", "gag"), ("ᎪᎡᎢ", "ART"), ("ᏙᎳᏁᏃ", "ᏙWᏁZ"), ("ⲤⲞⲢ", "COP"), ("ꓡꓲꓢꓴ", "LISU"), ("ɡas", "gas"), ("Մoսնտ", "Մօսնտ"),
    ],
)
def test_looks_the_same(a, b):
    assert a != b and consistent_text(a) == consistent_text(b)


@pytest.mark.parametrize(("a", "b"), [("1", "l"), ("0", "O"), ("rn", "m"), ("a b", "ab"), ("a b", "a  b"), ("a", "A"), ("e", "é"), ("a\nb", "a b"), ("ж", "x"), ("к", "k"), ("x²", "x2"), ("a¬", "a-"), ("a—b", "a-b"), ("…", "..."), ("ß", "ss"), ("æ", "ae"), ("", " "), ("ſ", "s"), ("α", "a"), ("в", "b"), ("н", "h"), ("т", "t"), ("I", "l"), ("O", "o"), ("ꓳ", "0"), ("Ӏ", "1"), ("か", "カ"), ("工", "I")])
def test_looks_different(a, b):
    assert consistent_text(a) != consistent_text(b)


def test_tokens_are_resolved_to_one_script():
    assert resolved_scripts("cop") == ({"Latin", "Cyrillic", "Greek", "Coptic"}, {"Latin"}) and resolved_scripts("сопь")[0] == {"Cyrillic"} and consistent_text("cопь") == "сопь"
    assert resolved_scripts("pаge") == ({"Latin"}, frozenset()) and resolved_scripts("zя")[0] == frozenset() and consistent_text("zяа") == "zяa"
    assert resolved_scripts("漢字かな")[1] == {"Japanese"} and resolved_scripts("漢한")[1] == {"Korean"} and resolved_scripts("ラーメン")[1] == {"Katakana", "Japanese"}


@pytest.mark.parametrize(
    ("token", "kind"),
    [
        ("pаge", "mixed"), ("сор", "whole"), ("дом", "none"), ("cépe", "none"), ("naive", "none"), ("漢字かな", "none"), ("カタカナー", "none"), ("한국어", "none"), ("漢한", "none"), ("kΩ", "none"), ("αカ", "none"), ("µm", "none"), ("zя", "none"),
        ("Ӏvan", "mixed"), ("ѴI", "mixed"), ("ԛ", "whole"), ("սո", "whole"), ("սon", "mixed"), ("ᎪᎡᎢ", "whole"), ("AᎡT", "mixed"), ("ⲤⲞⲢ", "whole"), ("ꓡꓲꓢꓴ", "whole"), ("ɡas", "none"), ("Ωа", "none"), ("12", "none"),
    ],
)
def test_kinds_of_confusables(token, kind):
    assert confusable_kind(folded(token)) == kind


def test_no_letter_is_in_two_classes():
    found = [c for row in LOOK_ALIKES.values() for c in row.split() if c != "."]
    assert len(found) == len(set(found)) and len({len(row.split()) for row in LOOK_ALIKES.values()}) == 1 and len(found) < 200
    assert {script_of(c) for s, row in LOOK_ALIKES.items() for c in row.split() if c != "." and script_of(c) != s} == set()


letters = [c for row in LOOK_ALIKES.values() for c in row.split() if c != "."]


@given(st.text(st.sampled_from([*letters, "ж", "b", "1", " ", "́", "​", "-"]), max_size=12), st.randoms())
def test_any_spelling_has_the_same_form(text, rng):
    rows = [row.split() for row in LOOK_ALIKES.values()]

    def other(c):
        for i in range(len(rows[0])):
            if c in [r[i] for r in rows]:
                return rng.choice([r[i] for r in rows if r[i] != "."])
        return {"-": "‑", " ": " "}.get(c, c) if rng.random() < 0.5 else c

    spelled = "".join(other(c) for c in text)
    assert consistent_text(spelled) == consistent_text(text)
    assert consistent_text(consistent_text(text)) == consistent_text(text)


@given(st.text(max_size=60))
def test_forms_are_stable_and_composed(text):
    once = consistent_text(text)
    assert consistent_text(once) == once and unicodedata.is_normalized("NFC", once)


def test_long_texts_take_linear_time():
    assert len(consistent_text("ж" * 300_000 + "​")) == 300_000 and len(folded("é" * 100_000)) == 200_000


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    forms = ["paper mill", "сор", "", "naïve", "page-1"]
    spell = lambda t: "".join(rng.choice([c, c, {"a": "а", "p": "р", "с": "c", "о": "o", "-": "‐", " ": " "}.get(c, c)]) for c in t) + rng.choice(["", "", "​"])
    docs = [(i, spell(rng.choice(forms))) for i in range(80)] + [(200 + i, "") for i in range(30)] + [(300, None), (None, "сор"), (5, "other"), (5, "оther")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as form", "1 as spelling")
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations([d for d in docs if None not in d], 2) if a != b and x != y and consistent_text(x) == consistent_text(y)}
    for per_salt in (5_000, 7):
        got = [tuple(r) for r in look_alike_pairs(df, per_salt).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = {r.doc_id: r for r in look_alike_classes(df).collect()}
    assert {x for p in want for x in p} <= set(classes) and all(r.class_id <= k and r.n_spellings > 1 for k, r in classes.items())
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_token_counts(spark):
    row = spark.createDataFrame([("pаge сор дом plain",), (None,)], "text string").select(confusable_tokens("text").alias("c")).collect()
    assert [tuple(r.c) for r in row] == [(1, 1), (0, 0)]
