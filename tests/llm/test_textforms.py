import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import textforms
from tests.conftest import rows

SAME = [
    ("ﬁne ﬂow", "fine flow"),
    ("Ｆｕｌｌ　１２３", "Full 123"),
    ("café", "café"),
    ("a​b­c﻿", "abc"),
    ("a b c", "a b c"),
    ("сосоа", "cocoa"),
    ("Нο", "Ho"),
    ("5 ℃, 3 ㎳, µm", "5 °C, 3 ms, μm"),
    ("non‑stop‐", "non-stop-"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("ﾌﾟﾚｰﾄ", "プレート"),
    ("ё", "ё"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("m²", "m2"), ("H₂O", "H2O"), ("a-b", "a–b"), ("a b", "a  b"), ("a b", "ab"), ("½", "1⁄2"), ("a,b", "a;b"), ("1st", "1ˢᵗ"), ("a\tb", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert textforms.visible_form(a) == textforms.visible_form(b)
    assert textforms.comparison_form(a) == textforms.comparison_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert textforms.visible_form(a) != textforms.visible_form(b)


@pytest.mark.parametrize("a,b", [("Straße", "STRASSE"), ("ΣΔΣ", "σδς"), ("m²", "M2"), ("a\tb", "A B")])
def test_comparison_ignores(a, b):
    assert textforms.comparison_form(a) == textforms.comparison_form(b)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=20))
def test_forms_are_stable(text):
    seen, compared = textforms.visible_form(text), textforms.comparison_form(text)
    assert textforms.visible_form(seen) == seen
    assert textforms.comparison_form(compared) == compared == textforms.comparison_form(seen)


DOCS = [
    (1, "fine"), (2, "ﬁne"), (3, "fine"), (4, "Fine"), (5, None), (6, ""), (7, " "), (8, " "), (9, "f​ine"), (10, "other"), (11, "other"),
    (None, "ﬁne"), (12, "x" * 100_000), (13, "x" * 99_999 + "х"),
]
SCHEMA = "doc_id long, text string"


def test_pairs(spark):
    df = spark.createDataFrame([(*d, "v") for d in DOCS], SCHEMA + ", visible string")
    got = rows(textforms.lookalike_pairs(df, "doc_id", "text"))
    assert got == sorted([(1, 2), (2, 3), (1, 9), (3, 9), (2, 9), (12, 13)], key=repr)
    assert textforms.lookalike_pairs(df.limit(0), "doc_id", "text").columns == ["doc_id_a", "doc_id_b"]


def test_a_third_of_all_texts_equal(spark):
    data = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(600)] + [(900, "ѕame text"), (901, "same text")]
    got = textforms.lookalike_pairs(spark.createDataFrame(data, SCHEMA), "doc_id", "text")
    assert got.count() == 401 and got.distinct().count() == 401


def test_classes(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    found = textforms.forms_classes(df, "doc_id", "text").collect()
    looks = {r["doc_id"]: (r["look_id"], r["look_size"]) for r in found}
    assert looks[1] == looks[2] == looks[3] == looks[9] == (1, 4) and looks[4] == (4, 1) and looks[12] == looks[13] == (12, 2)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in found}
    assert got[1] == got[2] == got[4] == got[9] == (1, 5) and got[11] == (10, 2) and 5 not in got and 7 not in got


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ａ", "z"), (2, None, None), (2, "", "z"), (3, "Ａ", "y")], "doc_id long, text string, own string")
    got = textforms.with_forms(df, "text")
    assert rows(got, "doc_id", "own", "comparison", "visible") == sorted([(1, "z", "a", "A"), (2, None, None, None), (2, "z", "", ""), (3, "y", "a", "A")], key=repr)


def test_many_spellings_and_copies(spark, monkeypatch):
    """Hot groups and hot texts are spread over tasks; the pairs stay the same."""
    letters = {"a": "а", "o": "о", "e": "е", "c": "с", "p": "р"}
    texts = ["".join(letters[x] if m >> k & 1 else x for k, x in enumerate("aoecp")) for m in range(32)]
    data = [(i, texts[i % 32] if i % 3 else texts[0]) for i in range(150)] + [(1_000 + i, f"other {i}") for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted(((a, b) for a, s in data for b, t in data if a < b < 1_000 and s != t), key=repr)
    assert rows(textforms.lookalike_pairs(df, "doc_id", "text")) == want
    monkeypatch.setattr(textforms, "HOT_ROWS", 5)
    assert rows(textforms.lookalike_pairs(df, "doc_id", "text")) == want


def test_lookalikes_are_published_ones(spark):
    """Each look-alike, or its other case, has the same skeleton as its Latin letter in Unicode's table of confusable characters."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    alike = lambda a, b: checker.getSkeleton(0, a) == checker.getSkeleton(0, b)
    for code, plain in textforms.LOOKALIKES.items():
        ch = chr(code)
        assert alike(ch, plain) or alike(ch.lower(), plain.lower()) or alike(ch.upper(), plain), (ch, plain)
