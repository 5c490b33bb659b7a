import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import tokens

if not os.path.exists(tokens.VOCABULARY):
    pytest.skip("the vocabulary is absent", allow_module_level=True)

CODER = tokens.Coder(open(tokens.VOCABULARY, "rb").read())
JSON = os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json")
TEXTS = ["", " ", "  \n\n\t x  ", "it's we've 'rest 's", "naïve ﬁ 測定 👍🏽 ​ x", "<|endoftext|>", "a" * 500, "don''''t  12345 67890 ___ !!!", "\r\n \r\n"]
pieces = st.sampled_from([" ", "  ", "\n", "'", "'r", "e", "ve", "ll", "a", "word", " word", "12", "é", "é", "測", "👍", "!", "...", " ", "<|endoftext|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=40).map("".join), st.integers(1, 20))
def test_tree_equals_whole(text, leaf):
    assert list(CODER.encode(text, leaf)) == CODER.plain(text)
    assert CODER.decode(CODER.encode(text, leaf)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(pieces, min_size=3, max_size=30).map("".join), st.data())
def test_join_is_associative(text, data):
    a, b = sorted(data.draw(st.lists(st.integers(0, len(text)), min_size=2, max_size=2)))
    x, y, z = CODER._leaf(text, 0, a), CODER._leaf(text, a, b), CODER._leaf(text, b, len(text))
    one, two = CODER.join(text, CODER.join(text, x, y), z), CODER.join(text, x, CODER.join(text, y, z))
    assert one.ids.tolist() == two.ids.tolist() == CODER.plain(text)


@pytest.mark.skipif(not os.path.exists(JSON), reason="the other form of the vocabulary is absent")
def test_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    for text in TEXTS:
        assert list(CODER.encode(text, 7)) == t.encode(text, add_special_tokens=False).ids


def test_long_texts():
    for text in ("x" * 100_000, "word " * 20_000, " " * 50_000 + "a", "\n" * 50_000):
        assert list(CODER.encode(text, 1_000)) == CODER.plain(text)
    assert CODER.decode(CODER.encode("é" * 60_000)) == "é" * 60_000


def test_spark(spark):
    data = [(i, t, [1], "x") for i, t in enumerate(TEXTS)] + [(90, None, None, "x"), (90, None, None, "x"), (None, "a", None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids array<int>, t string")
    got = tokens.encode_texts(df, "doc_id", "text", leaf=4)
    by = [(r["doc_id"], list(r["ids"])) for r in got.collect()]
    assert by == [(d[0], CODER.plain(d[1]) if d[1] else []) for d in data]
    back = tokens.decode_ids(got, "doc_id", "ids")
    assert [r["text"] for r in back.collect()] == [d[1] or "" for d in data]
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert tokens.decode_ids(df.select("doc_id", "ids").where("ids is null"), "doc_id", "ids").first()["text"] is None
