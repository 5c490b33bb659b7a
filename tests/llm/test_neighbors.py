import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lamella.llm import neighbors
from tests.conftest import rows

SCHEMA = "row long, v array<float>, rank int, neighbor string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], 1, "x") for i, v in zip(ids, vectors)], SCHEMA)


def truth(vectors, k=5):
    u = np.asarray(vectors, np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[: min(k, len(u) - 1)]}


def found(spark, df, **kw):
    return {(r["row"], r["neighbor"]) for r in neighbors.top_similar(df, "row", "v", 16, **kw).collect()}


def clumps(n, size, spread=0.1, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, 16))
    return (centres[:, None, :] + spread * rng.normal(size=(n, size, 16))).reshape(-1, 16)


def test_small_is_exact(spark):
    x = clumps(20, 9)
    assert found(spark, frame(spark, x)) == truth(x)


def test_recall(spark):
    x = clumps(300, 9)
    want = truth(x)
    got = found(spark, frame(spark, x), block_rows=100)
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)


def test_vectors_without_close_ones(spark):
    x = np.random.default_rng(4).normal(size=(200, 16))
    assert found(spark, frame(spark, x)) == truth(x)


def test_unusable_vectors_and_repeated_rows(spark):
    x = [list(v) for v in clumps(3, 8)]
    bad = [None, [], [1.0] * 15, [1.0] * 17, [0.0] * 16, [math.nan] * 16, [math.inf] + [0.0] * 15, [-math.inf] + [0.0] * 15]
    df = frame(spark, x + bad + x[:4], [*range(24), *range(24, 32), *range(4)])
    df = df.unionByName(frame(spark, [x[0]], [99]).selectExpr("cast(null as long) as row", "v", "rank", "neighbor"))
    assert found(spark, df) == truth(x)


def test_ties_prefer_small_ids(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(3, 16)), 9, 0)
    got = found(spark, frame(spark, x))
    assert got == truth(x)


def test_tiny_tables(spark):
    assert found(spark, frame(spark, [])) == set()
    assert found(spark, frame(spark, [[1.0] * 16])) == set()
    assert found(spark, frame(spark, [[1.0] * 16, [1.0] * 15 + [2.0]])) == {(0, 1), (1, 0)}
    assert found(spark, frame(spark, [[1e-30] * 16, [3e30] * 16])) == {(0, 1), (1, 0)}


def test_a_third_of_all_vectors_equal(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "HEAVY_COPIES", 20)
    x = np.vstack([clumps(10, 9), np.tile(np.random.default_rng(1).normal(size=16), (60, 1))])
    x = x[np.random.default_rng(0).permutation(len(x))]
    assert found(spark, frame(spark, x)) == truth(x)


def test_scaled_copies_of_a_heavy_vector(spark, monkeypatch):
    """Copies at other lengths are as similar as equal ones: the smallest ids count, whatever their length."""
    monkeypatch.setattr(neighbors, "HEAVY_COPIES", 20)
    v = np.random.default_rng(1).normal(size=16).astype(np.float32)
    x = np.vstack([clumps(10, 9), np.tile(v, (40, 1)) * np.array([1, 2, 0.5, 1024, 2.0**-30])[np.arange(40) % 5, None]])
    x = x[np.random.default_rng(0).permutation(len(x))]
    assert found(spark, frame(spark, x)) == truth(x)
    ids = np.random.default_rng(3).permutation(len(x)) * 7 - 300  # negative ids, too
    order = np.argsort(ids)
    assert found(spark, frame(spark, x, ids)) == {(int(ids[order][a]), int(ids[order][b])) for a, b in truth(x[order])}


@pytest.mark.parametrize("with_copies", [False, True])
def test_many_unusable_vectors_that_are_equal(spark, monkeypatch, with_copies):
    monkeypatch.setattr(neighbors, "HEAVY_COPIES", 20)
    x = clumps(10, 9)
    if with_copies:
        x = np.vstack([x, np.tile(np.random.default_rng(1).normal(size=16), (40, 1))])
    bad = [[0.0] * 16, [-0.0] * 16, [math.nan] * 16, [1.0] * 15 + [math.nan], [math.inf] + [0.0] * 15, [-math.inf] + [0.0] * 15]
    df = frame(spark, [*x, *(v for v in bad for _ in range(40))])
    gaps = spark.range(1_000, 1_040).selectExpr("id as row", "transform(sequence(1, 16), i -> if(i = 3, null, cast(i as float))) as v", "1 as rank", "'x' as neighbor")
    assert found(spark, df.unionByName(gaps)) == truth(x)


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TILE_ROWS", 60)
    x = clumps(25, 9)
    assert found(spark, frame(spark, x)) == truth(x)


def test_pairs(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (5, 3)], "row long, neighbor long")
    assert rows(neighbors.neighbor_pairs(df, "row")) == [(1, 2), (3, 5)]


def test_two_level_pivots():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400, 16))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = p + 0.05 * rng.normal(size=p.shape)
    flat, deep = neighbors.Pivots(p, 3), neighbors.Pivots(p, 3, flat=100)
    a, b = flat.nearest(q), deep.nearest(q)
    assert np.mean([len(set(x) & set(y)) / 3 for x, y in zip(a, b)]) > 0.9
    assert np.mean([i in set(y) for i, y in enumerate(b)]) > 0.98


@pytest.mark.parametrize("seed", range(3))
def test_blocks_against_brute_force(seed):
    x = clumps(30, 8, seed=seed)
    ids = np.random.default_rng(seed).permutation(len(x)) * 3
    near, cosine = neighbors.block_neighbors(ids, neighbors.quantise(x / np.linalg.norm(x, axis=1, keepdims=True)), 5)
    order = np.argsort(ids)
    want = truth(x[order])
    got = {(int(np.searchsorted(ids[order], i)), int(np.searchsorted(ids[order], j))) for i, r in zip(ids, near) for j in r}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.98
    assert (np.diff(cosine, axis=1) <= 0).all()


def test_windows_expand_until_enough_is_found():
    """Close neighbours are found in the first windows; only queries with fewer than k candidates reach the ends of the arrays."""
    x = clumps(60, 9, spread=0.05)
    trace = []
    packed = neighbors.quantise(x / np.linalg.norm(x, axis=1, keepdims=True))
    neighbors.block_neighbors(np.arange(len(x)), packed, 5, trace=trace)
    assert trace[0][0] == neighbors.FIRST_HALF and sum(t[1] for t in trace if t[0] > 1) < 0.1 * len(x)
    few = np.random.default_rng(0).normal(size=(7, 16))
    near, _ = neighbors.block_neighbors(np.arange(7), neighbors.quantise(few / np.linalg.norm(few, axis=1, keepdims=True)), 6, trace=trace)
    assert (np.sort(near, 1) == [[j for j in range(7) if j != i] for i in range(7)]).all() and trace[-1][0] > 1


def test_windows_are_differences_of_sets():
    v = np.random.default_rng(0).normal(size=(700, 3)).astype(np.float32)
    arrays = neighbors.SortedArrays(v)
    for half in (0.0, 0.3, 9.0):
        got = np.unpackbits(arrays.within(1, v[:50, 1], half).view(np.uint8), axis=1, bitorder="little")[:, :700].astype(bool)
        want = np.abs(v[None, :, 1] - v[:50, 1, None]) <= half
        assert (got >= want).all() and (got.sum(1) - want.sum(1)).max() <= 2 * arrays.step


@given(st.lists(st.integers(0, 255), min_size=1, max_size=20), st.integers(0, 20))
def test_counting_bits(sets, least):
    got = neighbors.at_least(neighbors.added_up(np.array([x], np.uint64) for x in sets), least)[0]
    assert [int(got) >> b & 1 for b in range(8)] == [int(sum(x >> b & 1 for x in sets) >= least) for b in range(8)]


def test_large_blocks_are_divided(spark, monkeypatch):
    x = clumps(200, 9)
    packed = neighbors.quantise(x / np.linalg.norm(x, axis=1, keepdims=True))
    whole, _ = neighbors.block_neighbors(np.arange(len(x)), packed, 5)
    monkeypatch.setattr(neighbors, "SPLIT_ROWS", 300)
    ids = np.random.default_rng(0).permutation(len(x))
    near, cosine = neighbors.divided_neighbors(ids, packed[ids], 5, np.ones(len(ids), bool), 3, 100)
    assert np.mean([len(set(near[i]) & set(whole[r])) / 5 for i, r in enumerate(ids)]) > 0.98
    assert all(len(set(r)) == 5 for r in near) and (np.diff(cosine, axis=1) <= 0).all()
    want = truth(x)
    assert len(found(spark, frame(spark, x), block_rows=2_000) & want) / len(want) > 0.98


def test_many_candidates_are_verified_in_parts(monkeypatch):
    x = np.random.default_rng(0).normal(size=16) + 0.01 * np.random.default_rng(1).normal(size=(900, 16))
    packed = neighbors.quantise(x / np.linalg.norm(x, axis=1, keepdims=True))
    want = neighbors.block_neighbors(np.arange(900), packed, 5)
    monkeypatch.setattr(neighbors, "CANDIDATES", 2_000)
    got = neighbors.block_neighbors(np.arange(900), packed, 5)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_pivots_move_to_the_middle():
    x = clumps(6, 50, spread=0.02)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    moved = neighbors.centred(x, x[::50] + 0.05)
    assert (moved @ x.reshape(6, 50, 16).mean(1).T).max(1).min() > 0.99
