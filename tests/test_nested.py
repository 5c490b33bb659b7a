import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.operators import nested
from tests.conftest import rows


def by_paths(text):
    """The same rows from the definition, without labels: positions are carried along."""
    out = []

    def load(s):
        return json.loads(s, parse_float=nested.Number, parse_int=nested.Number, parse_constant=nested._refuse)

    def stands_for(v):
        if type(v) is str:
            try:
                w = load(v)
            except ValueError:
                return v
            return w if isinstance(w, (dict, list)) else v
        return v

    def array(v):
        v = stands_for(v)
        return v if isinstance(v, list) else [v] if isinstance(v, dict) or type(v) is str else []

    def key(d, name):
        v = d.get(name)
        return "" if v is None else str(v) if isinstance(v, str) else nested.named(v)

    try:
        top = stands_for(load(text))
    except ValueError:
        return out
    if not isinstance(top, dict):
        return out
    for i, s in enumerate(array(top.get("sources"))):
        s = stands_for(s)
        if not isinstance(s, dict):
            continue
        out.append(("source", i, -1, -1, key(s, "source_image")))
        for j, p in enumerate(array(s.get("plates"))):
            p = stands_for(p)
            if not isinstance(p, dict):
                continue
            out.append(("plate", i, j, -1, key(p, "plate_id")))
            qc = stands_for(p.get("qc"))
            for k, f in enumerate(array(qc.get("flags")) if isinstance(qc, dict) else []):
                f = stands_for(f)
                if type(f) is str:
                    out.append(("flag", i, j, k, f))
            for k, n in enumerate(array(p.get("nearest_reference_plates"))):
                n = stands_for(n)
                if isinstance(n, dict):
                    out.append(("neighbor", i, j, k, key(n, "plate_id")))
    for k, b in enumerate(array(top.get("bilateral_analysis"))):
        b = stands_for(b)
        if isinstance(b, dict):
            out.append(("pair", -1, -1, k, key(b, "bilateral_pair_id")))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(f"e{i}", t, "x") for i, t in enumerate(texts)], "exam_id string, doc string, entity string")
    got = nested.exam_nodes(nested.flatten(docs, "exam_id", "doc"), "exam_id")
    return rows(got)


CASES = [
    None,
    "",
    "  ",
    "null",
    "[]",
    "7",
    '"text"',
    "{",
    '{"sources": NaN}',
    '{"sources": [{}, null, 3, "x", [], {"source_image": 1.50}]}',
    '{"sources": {"source_image": "a", "plates": {"plate_id": 7, "qc": {"flags": "LOW"}, "nearest_reference_plates": "none"}}}',
    json.dumps({"sources": json.dumps([{"plates": json.dumps({"plate_id": None, "qc": json.dumps({"flags": ["A", None, 2, "B", ["C"], '{"a":1}']})})}])}),
    json.dumps(json.dumps({"bilateral_analysis": [1, {"bilateral_pair_id": "p"}, {"bilateral_pair_id": True}, {}]})),
    # a text that holds a text that holds a list is a text: no neighbours, but a flag
    json.dumps({"sources": [{"plates": [{"nearest_reference_plates": json.dumps(json.dumps([{"plate_id": "q"}])), "qc": {"flags": json.dumps(json.dumps(["A"]))}}]}]}),
    json.dumps(json.dumps(json.dumps({"sources": [{}]}))),
    json.dumps({"sources": [{"source_image": "x" * 50_000, "plates": [{"plate_id": i} for i in range(3_000)]}]}),
]


def test_cases(spark):
    want = [(f"e{i}", *r) for i, t in enumerate(CASES) if t is not None for r in by_paths(t)]
    assert found(spark, CASES) == sorted(want, key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_too_deep():
    assert nested.node_tables('{"a":' * 200_000) is None


values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3) | st.just('{"plate_id": "q"}'),
    lambda inner: st.lists(inner, max_size=3)
    | st.dictionaries(st.sampled_from(["sources", "plates", "qc", "flags", "plate_id", "nearest_reference_plates", "bilateral_analysis", "source_image"]), inner, max_size=4)
    | inner.map(json.dumps),
    max_leaves=25,
)


@settings(max_examples=300, deadline=None)
@given(values)
def test_labels_equal_paths(value):
    text = json.dumps(value)
    tables = nested.node_tables(text)
    got = []
    paths = {}
    for kind in nested.EXAM_KINDS if tables else ():
        own = tables[kind.name]
        paths[kind.name] = [[*(paths[kind.parent][p] if kind.parent else []), int(i)] for p, i in zip(own["parent"], own["index"])]
        for path, key in zip(paths[kind.name], own["key"]):
            s, p, k = (path + [-1, -1])[:3] if kind.name != "pair" else (-1, -1, path[0])
            got.append((kind.name, s, p, k, key))
    assert sorted(got) == sorted(by_paths(text))


@settings(max_examples=100, deadline=None)
@given(values)
def test_intervals_nest(value):
    tables = nested.node_tables(json.dumps(value)) or {}
    nodes = [(int(a), int(b)) for t in tables.values() for a, b in zip(t["pre"], t["post"])]
    assert len({a for a, _ in nodes}) == len({b for _, b in nodes}) == len(nodes)
    for kind in nested.EXAM_KINDS if tables else ():
        if kind.parent:
            own, above = tables[kind.name], tables[kind.parent]
            for pre, post, p in zip(own["pre"], own["post"], own["parent"]):
                around = [i for i, (a, b) in enumerate(zip(above["pre"], above["post"])) if a < pre and b > post]
                assert around == [p]


def test_every_node_is_labelled():
    text = '{"a": {"b": [1, {"c": null}]}, "sources": [7, {"note": [[]], "source_image": "s", "plates": {"qc": {"x": 1, "flags": ["f"]}}}, {}], "z": 0}'
    t = nested.node_tables(text)
    # the document is 0; a, b, 1, {c}, null are 1 to 5; sources is 6, its first element 7
    assert t["source"]["pre"].tolist() == [8, 17] and t["source"]["index"].tolist() == [1, 2]
    assert t["plate"]["pre"].tolist() == [12] and t["flag"]["pre"].tolist() == [16]
    # nodes are left in the order null, {c} ... so that all 19 nodes have a number
    assert t["flag"]["post"].tolist() == [10] and t["plate"]["post"].tolist() == [13] and t["source"]["post"].tolist() == [14, 15]


def test_latest_document(spark):
    data = [
        ("a", "2024-01-01T10:00:00+02:00", "old"),
        ("a", "2024-01-01T08:30:00Z", "new"),
        ("a", "2024-01-01T09:29:59.999999+01:00", "older"),
        ("b", "no time", "only"),
        ("c", None, "x"),
        ("c", "2024-01-01T00:00:00Z", None),
        (None, "2024-01-01T00:00:00Z", "lost"),
        ("d", "2024-01-01T00:00:00Z", "1"),
        ("d", "2024-01-01T00:00:00+00:00", "2"),
    ]
    df = spark.createDataFrame(data, "exam_id string, created_at string, doc string")
    assert rows(nested.latest_documents(df, "exam_id", "created_at", "doc")) == [("a", "new"), ("b", "only"), ("c", None), ("d", "2")]


@pytest.mark.parametrize("text,want", [("1.50", "1.50"), ("1e3", "1e3"), ("12345678901234567890123", "12345678901234567890123"), ("true", "true"), ("null", "")])
def test_numbers_keep_their_spelling(text, want):
    t = nested.node_tables('{"sources": [{"source_image": %s}]}' % text)
    assert t["source"]["key"] == [want]
