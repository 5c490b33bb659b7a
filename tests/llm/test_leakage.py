import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import leakage, queries
from tests.conftest import rows


def by_definition(doc, item):
    """Whether the words of a document hold those of an item, tried out in all ways."""
    if not item:
        return False
    if not set(doc) & set(item):
        return False
    if len(item) < 12:
        return any(doc[j : j + len(item)] == item for j in range(len(doc)))
    for i in range(len(item) - 11):
        q = item[i : i + 12]
        for j in range(len(doc) + 1):
            for k in range(12):
                part = lambda n: doc[j : j + n]
                if part(11) == q[:k] + q[k + 1 :]:
                    return True
                if len(part(12)) == 12 and part(12)[:k] + part(12)[k + 1 :] == q[:k] + q[k + 1 :]:
                    return True
                if k and len(part(13)) == 13 and part(13)[:k] + part(13)[k + 1 :] == q:
                    return True
    return False


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_check(data):
    letters = st.integers(0, data.draw(st.integers(1, 6)))
    item = data.draw(st.lists(letters, min_size=1, max_size=18))
    doc = data.draw(st.lists(letters, max_size=24))
    if data.draw(st.booleans()):
        part = item[: data.draw(st.integers(1, 14))]
        at = data.draw(st.integers(0, len(part)))
        part = part[:at] + data.draw(st.lists(letters, max_size=1)) + part[at + data.draw(st.integers(0, 1)) :]
        doc = (doc[:5] + part + doc)[:24]
    seq = np.array([doc + [-1] * (24 - len(doc))], np.int32)
    got = leakage.holds(seq, np.array([item + [-2, -2]], np.int32), np.array([len(item)]))[0]
    assert got == by_definition(doc, item)


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("", []),
        ("> A-b\n> C_d 3.5", ["a", "b", "c", "d", "3", "5"]),
        ("<p>On<b>e</b></p><br/>tw­o &amp; 3 < 4", ["one", "two", "3", "4"]),
        ('{"a": "x\\ny\\u00e9 \\"z\\""}', ["a", "x", "yé", "z"]),
        ("Ｆｕｌｌ сосоа ﬁn​e", ["full", "cocoa", "fine"]),
        ("don't", ["don", "t"]),
    ],
)
def test_words(text, want):
    assert leakage.words(text) == want


def test_passages_cover_every_stretch():
    sizes = [*range(80), 0, 0, 5]
    flat, ends = np.concatenate([1_000 * k + np.arange(n, dtype=np.int32) for k, n in enumerate(sizes)]), np.cumsum(sizes)
    rows, owner = leakage.passages(flat, ends)
    assert rows.shape[1] == leakage.PASSAGE and set(owner) == set(range(len(sizes))) and (np.diff(owner) >= 0).all()
    for k, n in enumerate(sizes):
        p = [set(r[r >= 0].tolist()) for r in rows[owner == k]]
        assert set().union(*p) == {1_000 * k + i for i in range(n)}
        for size in (1, 12, 13):
            for s in range(n - size + 1):
                assert any(set(range(1_000 * k + s, 1_000 * k + s + size)) <= r for r in p)
    assert leakage.passages(np.zeros(0, np.int32), np.zeros(0, np.int64))[0].shape == (0, leakage.PASSAGE)


def test_stored_sequences():
    data = pa.array([np.array(x, np.int32).tobytes() for x in ([1, 2], [], [3, -1, 4])], pa.binary())
    for column, want in ((data, ([1, 2, 3, -1, 4], [2, 2, 5])), (data[1:], ([3, -1, 4], [0, 3])), (data[:0], ([], []))):
        flat, ends = leakage.sequences(column)
        assert (flat.tolist(), ends.tolist()) == want


def truth(docs, items):
    """Pairs that hold; two texts of different words share enough of them, or none holds the other."""
    near = lambda w, q: len(set(w) & set(q)) >= min(len(set(q)), 8)
    return sorted(((d, i) for d, w in docs for i, q in items if near(w, q) and by_definition(w, q)), key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{i}" for i in range(900)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.choice([6, 9, 20, 40]))) for i in range(30)]
    docs = []
    for d in range(260):
        w = words(rng.randint(0, 120))
        if d % 3 == 0:
            item = rng.choice(items)[1]
            part = item[:] if len(item) < 12 else item[(s := rng.randrange(len(item) - 12)) : s + rng.choice([9, 10, 12, 13])]
            edit = rng.randrange(4)
            k = rng.randrange(1, len(part) - 1)
            part = [part, part[:k] + part[k + 1 :], part[:k] + ["new"] + part[k:], part[:k] + ["new"] + part[k + 1 :]][edit]
            at = rng.randint(0, len(w))
            w = w[:at] + part + w[at:]
        docs.append((d, w))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = truth(docs, items)
    assert len(want) > 30
    style = lambda d, w: " ".join(w) if d % 2 else "<p>" + ",\n> ".join(x.upper() for x in w) + "</p>"
    df = spark.createDataFrame([(d, style(d, w), "x", 0) for d, w in docs], "doc_id long, text string, item_id string, m int")
    it = spark.createDataFrame([(i, " ".join(q), "y") for i, q in items], "item_id long, text string, d string")
    assert rows(leakage.leaks(df, it, "doc_id", "item_id", "text")) == want


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 7)
    docs, items = corpus(1)
    docs = docs[:60]
    want = truth(docs, items)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    assert rows(leakage.leaks(df, it, "doc_id", "item_id", "text")) == want


def test_nulls_copies_and_long_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    long = "filler " * 30_000 + item.upper() + " filler" * 30_000
    docs = [(1, None), (2, ""), (3, "  \n"), (4, long), (5, item), (5, item), (6, item), (None, item)]
    its = [(1, item), (2, item), (3, None), (4, ""), (5, "!!"), (None, item), (6, "seven eight")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(its, "item_id long, text string")
    got = rows(leakage.leaks(df, it, "doc_id", "item_id", "text"))
    assert got == sorted((d, i) for d in (4, 5, 6) for i in (1, 2, 6))
    assert leakage.leaks(df.limit(0), it, "doc_id", "item_id", "text").count() == 0
    assert leakage.leaks(df, it.limit(0), "doc_id", "item_id", "text").count() == 0
    report = leakage.item_report(leakage.leaks(df, it, "doc_id", "item_id", "text"), it.where("item_id < 4"), "doc_id", "item_id")
    assert rows(report) == [(1, 3, 0), (2, 3, 0), (3, 0, 0)]


def pairs_of(spark, docs, items):
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    return rows(leakage.leaks(df, it, "doc_id", "item_id", "text"))


def numbered_words(prefix, n):
    return [f"{prefix}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]


def test_a_third_of_all_documents_are_copies(spark):
    rng = random.Random(5)
    other, leak = numbered_words("o", 400), numbered_words("l", 16)
    items = [(0, leak), *((i, rng.sample(other, 16)) for i in range(1, 20))]
    copy = rng.sample(other, 10) + leak[2:8] + ["changed"] + leak[9:15] + rng.sample(other, 10)
    docs = [(d, copy if d % 3 == 0 else rng.sample(other, 40)) for d in range(300)]
    assert pairs_of(spark, docs, items) == sorted(((d, 0) for d in range(0, 300, 3)), key=repr)


def test_boilerplate_in_all_documents(spark):
    rng = random.Random(6)
    other, leak = numbered_words("o", 400), numbered_words("l", 12)
    items = [(0, leak), *((i, rng.sample(other, 16)) for i in range(1, 20))]
    docs = [(d, rng.sample(other, 12 + d % 9) + leak + rng.sample(other, 20)) for d in range(300)]
    assert pairs_of(spark, docs, items) == sorted(((d, 0) for d in range(300)), key=repr)


def test_shared_runs():
    """Whatever the check accepts shares a run; here with words that occur in all items."""
    rng = random.Random(7)
    items = [[rng.randrange(3) for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 20]))] for _ in range(40)]
    table = np.full((40, 20), -2, np.int32)
    for k, q in enumerate(items):
        table[k, : len(q)] = q
    lengths = np.array([len(q) for q in items])
    docs = np.array([[rng.randrange(-1, 3) for _ in range(24)] for _ in range(60)], np.int32)
    got = leakage.sharing(docs, leakage.stretch_runs(table, lengths), 40)
    n = np.minimum(lengths, 6)
    runs = lambda w, m: {tuple(w[j : j + m]) for j in range(len(w) - m + 1)}
    assert got.tolist() == [d * 40 + k for d in range(60) for k, q in enumerate(items) if runs(docs[d].tolist(), n[k]) & runs(q, n[k])]
    held = [d * 40 + k for d in range(60) for k in range(40) if leakage.holds(docs[d : d + 1], table[k : k + 1], lengths[k : k + 1])[0]]
    assert held and set(held) <= set(got.tolist())


@pytest.mark.parametrize("how", [dict(cosine=2.0), dict(rank=2)])
def test_nothing_depends_on_the_latent_space(spark, how):
    """Windows of frequent words within rare ones, one word changed or dropped, are found without any near direction."""
    rng = random.Random(8)
    rare, often = numbered_words("r", 600), numbered_words("f", 30)
    items = [(i, rng.sample(often, 12)) for i in range(20)] + [(20 + i, rng.sample(rare, 30)) for i in range(20)] + [(40, often[:2]), (41, rare[:7])]
    docs = []
    for d in range(84):
        part = list(items[d % 42][1][:12])
        if len(part) == 12:
            part[rng.randrange(1, 11)] = "changed" if d % 2 else rng.choice(rare)
        docs.append((d, rng.sample(rare, 12 + d % 12) + part + rng.sample(rare, 12)))
    want = truth(docs, items)
    assert len(want) >= 84
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    assert rows(leakage.leaks(df, it, "doc_id", "item_id", "text", **how)) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_common_subsequence(data):
    letters = st.integers(0, data.draw(st.integers(1, 6)))
    passage, stretch = data.draw(st.lists(letters, max_size=24)), data.draw(st.lists(letters, max_size=16))
    p = np.array([passage + [-1] * (24 - len(passage))], np.int32)
    q = np.array([stretch + [-2] * (16 - len(stretch))], np.int32)
    assert leakage.common_subsequence(p, q)[0] == lcs(passage, stretch)


def test_stretches_cover_every_window():
    for n in range(1, 60):
        words = numbered_words("w", n)
        vocabulary = {w: k for k, w in enumerate(words)}
        got = leakage.Stretches.of([(7, words)], vocabulary, np.ones(n, np.float32))
        assert (got.short == (n < 12)).all() and (got.owner == 0).all() and got.names == [7]
        if n < 12:
            assert got.rows[0, :n].tolist() == list(range(n)) and len(got.rows) == 1
        for s in range(n - 11):
            assert any(set(range(s, s + 12)) <= set(r.tolist()) for r in got.rows)


def test_leading_directions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 60)) + 0.01 * rng.normal(size=(400, 60))
    random = rng.normal(size=(60, 20))
    got = leakage.leading_directions(x.T @ (x @ random), random, 12)
    want = np.linalg.svd(x, full_matrices=False)[2][:12]
    assert np.allclose(np.linalg.svd(want @ got)[1], 1, atol=1e-3)  # the same space


def test_paraphrases(spark):
    """The order of most words and the answer must be there; one row for a pair, held or not."""
    item = "why does the amber halo of torvim widen after 3884 slow ticks beside the wet gauze".split()
    told = "so why would the amber halo of torvim then widen when 3884 ticks of wet gauze pass".split()
    other = "so why would the amber halo of torvim then widen when 99 ticks of wet gauze pass".split()
    docs = [(1, item), (2, told), (3, other), (4, told + item), (5, list(reversed(item))), (6, ["halo"])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(1, " ".join(item)), (2, "unrelated words")], "item_id long, text string")
    found = leakage.leaks(df, it, "doc_id", "item_id", "text", paraphrases=True)
    assert rows(found) == [(1, 1, True), (2, 1, False), (4, 1, True)]
    assert rows(leakage.item_report(found, it, "doc_id", "item_id")) == [(1, 2, 1), (2, 0, 0)]
    assert rows(leakage.leaks(df, it, "doc_id", "item_id", "text")) == [(1, 1), (4, 1)]


def test_queries_check_answers(spark, tmp_path):
    """The queries go through all steps: p8_items counts paraphrases, p8_found lists only what is held."""
    item = "why does the amber halo of torvim widen after 3884 slow ticks beside the wet gauze"
    told = "so why would the amber halo of torvim then widen when 3884 ticks of wet gauze pass"
    docs = [(1, item), (2, told), (3, told.replace("3884", "99")), (4, f"{told} {item}"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, item), (2, "unrelated words"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert rows(queries.p8_items(spark, str(tmp_path))) == [(1, 2, 1), (2, 0, 0), (3, 0, 0)]
    found = queries.p8_found(spark, str(tmp_path))
    assert found.columns == ["doc_id", "item_id"] and rows(found) == [(1, 1), (4, 1)]


def test_groups_of_words(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WORDS", 60)
    monkeypatch.setattr(leakage, "PIECE_WORDS", 16)
    monkeypatch.setattr(leakage, "FAN_IN", 2)
    docs, items = corpus(2)
    docs = docs[:80]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(7)
    it = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    assert rows(leakage.leaks(df, it, "doc_id", "item_id", "text")) == truth(docs, items)


def test_many_items(spark):
    """5,000 items, worked on at once; the corpus is read into words once."""
    rng = random.Random(9)
    vocabulary = numbered_words("v", 676) + numbered_words("u", 676)
    items = [(i, rng.sample(vocabulary, 14)) for i in range(5_000)]
    docs = [(d, rng.sample(vocabulary, 8) + items[d * 61][1][1:13] + rng.sample(vocabulary, 8)) for d in range(80)]
    got = pairs_of(spark, docs, items)
    assert set(got) >= {(d, d * 61) for d in range(80)} and len(got) == 80
