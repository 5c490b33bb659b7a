import math

import numpy as np
import pandas as pd
import pytest

from lamella.llm import clusters
from tests.conftest import rows

AXES = (clusters.Axis("area", 0.03), clusters.Axis("ratio", 0.08, "ratio"), clusters.Axis("hue", 5.0, "circle", length=180.0))
SCHEMA = "plate string, label string, area double, ratio double, hue double, group_id string"


def crowd(rng, name, label, area, ratio, hue, n):
    a, r, h = rng.normal(area, 0.01, n), np.exp(rng.normal(math.log(ratio), 0.03, n)), rng.normal(hue, 2.5, n) % 180
    return [(f"{name}{i:04d}", label, float(x), float(y), float(z), "?") for i, (x, y, z) in enumerate(zip(a, r, h))]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    out = crowd(rng, "a", "x", 0.3, 1.5, 0, 900)  # around the seam of the circle
    out += crowd(rng, "b", "x", 0.3, 1.5, 60, 60)
    out += crowd(rng, "c", "x", 0.3, 4.0, 0, 300)
    out += crowd(rng, "d", "y", 0.3, 1.5, 0, 40)  # another label at the same place
    out += [("lone", "x", 0.9, 9.0, 120.0, "?"), ("null", None, 0.3, 1.5, 0.0, "?"), ("nan", "x", math.nan, 1.5, 0.0, "?"), ("none", "x", None, 1.5, 0.0, "?"), ("inf", "x", 0.3, math.inf, 0.0, "?")]
    return out


def test_groups(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = clusters.cluster(df, "plate", "label", AXES)
    assert got.columns == ["plate", "label", "group_id", "group_size", "typical_members"]
    sets = {}
    for r in got.collect():
        sets.setdefault(r["group_id"], []).append(r)
    assert {k[0] for k in sets} == set("abcd") and len(sets) == 4
    for key, members in sets.items():
        want = sum(d[0][0] == key[0] and len(d[0]) == 5 for d in data)
        assert abs(len(members) - want) <= 0.02 * want and {m["group_size"] for m in members} == {len(members)}
        assert {m["plate"][0] for m in members} == {key[0]} and len(members[0]["typical_members"]) == 3
    assert not {"lone", "null", "nan", "none", "inf"} & {r["plate"] for m in sets.values() for r in m}
    assert rows(clusters.cluster(df.repartition(7), "plate", "label", AXES)) == rows(got)


def test_typical_members_are_near_the_middle(spark, data):
    place = {d[0]: d for d in data}
    got = clusters.cluster(spark.createDataFrame(data, SCHEMA), "plate", "label", AXES).where("group_id like 'a%'").first()
    for p in got["typical_members"]:
        hue = place[p][4]
        assert abs(place[p][2] - 0.3) < 0.01 and min(hue, 180 - hue) < 3


def test_empty_and_equal_points(spark):
    assert clusters.cluster(spark.createDataFrame([], SCHEMA), "plate", "label", AXES).count() == 0
    same = [(f"p{i}", "x", 0.5, 2.0, 90.0, "?") for i in range(6)]
    assert clusters.cluster(spark.createDataFrame(same, SCHEMA), "plate", "label", AXES).first()["group_size"] == 6


def test_far_values_keep_their_distance(spark):
    far = [(f"{x}{i}", "x", 0.5, v, 90.0, "?") for i in range(6) for x, v in (("p", 1e300), ("q", 1e299), ("r", 3e3), ("s", 2.0))]
    got = clusters.cluster(spark.createDataFrame(far, SCHEMA), "plate", "label", AXES).collect()
    assert len(got) == 24 and {r["group_size"] for r in got} == {6} and all(r["group_id"] == r["plate"][0] + "0" for r in got)


def test_pairs(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "plate string, group_id int")
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c"), ("a", "a"), ("a", "zz"), (None, "a")], "x string, y string")
    assert rows(clusters.same_group_pairs(groups, pairs, "plate", "x", "y")) == [("a", "b")]


def summary(points, nodes):
    """Count, mean and mean squared distance from it of each node's points."""
    own = [points[nodes == k] for k in range(nodes.max() + 1)]
    mean = np.array([p.mean(0) for p in own])
    return np.array([len(p) for p in own]), mean, np.array([((p - m) ** 2).sum(1).mean() for p, m in zip(own, mean)])


def slow_linkage(points, nodes, threshold, reach):
    """One merge at a time, always the two most similar clusters of all, from all pairs of points."""
    group = {k: [k] for k in range(nodes.max() + 1)}
    alike = 1 - ((points[:, None] - points[None]) ** 2).sum(2) / reach**2

    def similarity(a, b):
        return alike[np.isin(nodes, group[a])][:, np.isin(nodes, group[b])].mean()

    while len(group) > 1:
        s, a, b = max((similarity(a, b), a, b) for a in group for b in group if a < b)
        if s < threshold:
            break
        group[a] += group.pop(b)
    return sorted(sorted(g) for g in group.values())


@pytest.mark.parametrize("seed", range(20))
def test_rounds_equal_one_merge_at_a_time(seed):
    rng = np.random.default_rng(seed)
    size = 14
    nodes = np.r_[np.arange(size), rng.integers(0, size, 36)]
    points = (rng.random((size, 3)) * 4)[nodes] + rng.normal(0, 0.3, (50, 3))
    a, b = np.triu_indices(size, 1)  # a full graph: average linkage is reducible on it
    label = clusters.merge_rounds(*summary(points, nodes), a, b, 0.6, 3.0)
    got = sorted(sorted(np.flatnonzero(label == g).tolist()) for g in set(label))
    assert 1 < len(got) < size and got == slow_linkage(points, nodes, 0.6, 3.0)


def components(n, mean, spread, a, b, threshold):
    """What average linkage is not: everything that is linked."""
    label = np.arange(len(n))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new[new] == label).all():
            return label
        label = new[new]


def cells_of(x):
    plain = (clusters.Axis("a", 1.0), clusters.Axis("b", 1.0), clusters.Axis("c", 1.0))
    t = pd.DataFrame(np.floor(x).astype(int), columns=["c0", "c1", "c2"])
    t[["m0", "m1", "m2"]] = x
    by = t.groupby(["c0", "c1", "c2"])
    return plain, by.mean().assign(v=by.var(ddof=0)[["m0", "m1", "m2"]].sum(axis=1), n=by.size()).reset_index(), t


def group_of(x, linkage=clusters.merge_rounds):
    axes, cells, points = cells_of(x)
    return points.merge(clusters.link_cells(cells, axes, clusters.THRESHOLD, linkage), "left", ["c0", "c1", "c2"])["g"].fillna(-1).astype(int).to_numpy()


def test_a_thin_bridge_does_not_join_crowds():
    """Average linkage decides, not connection: with components in its place the crowds are one."""
    rng = np.random.default_rng(1)
    left, right = rng.normal(0, 0.7, (2_000, 3)), rng.normal(0, 0.7, (500, 3)) + [14, 0, 0]
    bridge = np.column_stack([np.linspace(2, 12, 60), np.zeros(60), np.zeros(60)])
    x = np.vstack([left, right, bridge]) + 50
    got, joined = group_of(x), group_of(x, components)
    main = lambda g, part: np.bincount(g[part] + 1).argmax() - 1
    a, b = slice(0, 2_000), slice(2_000, 2_500)
    assert main(got, a) != main(got, b) and main(got, a) >= 0 and main(got, b) >= 0
    assert (got[a] == main(got, a)).mean() > 0.97 and (got[b] == main(got, b)).mean() > 0.97
    assert main(joined, a) == main(joined, b)


def test_a_wide_crowd_is_split_at_the_threshold_only():
    """Similarities lie on both sides of the threshold: a crowd that is wider than it is cut, a narrower one is not."""
    rng = np.random.default_rng(2)
    for length, whole in ((7, True), (40, False)):
        x = np.column_stack([rng.random(4_000) * length, rng.normal(0, 0.4, 4_000), rng.normal(0, 0.4, 4_000)]) + 50
        assert (len(set(group_of(x)) - {-1}) == 1) == whole
        assert len(set(group_of(x, components)) - {-1}) == 1


@pytest.mark.parametrize("others", [300, 3_000, 1_000_000])
def test_five_records_are_a_crowd_beside_any_number_of_others(others):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.7, (others, 3)).clip(-3, 3), rng.normal(0, 0.2, (5, 3)) + 20.5, rng.normal(0, 0.2, (4, 3)) - 20.5])
    got = group_of(x)
    assert len(set(got[-9:-4])) == 1 and got[-9] >= 0 and got[-9] != got[0]
    assert set(got[-4:]) == {-1}  # fewer than LEAST_GROUP


def test_noise_is_no_crowd():
    rng = np.random.default_rng(4)
    for n in (500, 5_000, 20_000):
        noise = rng.random((n, 3)) * 34
        assert set(group_of(noise)) == {-1}
        x = np.vstack([noise, rng.normal(0, 0.6, (800, 3)).clip(-2, 2) + [10, 20, 15]])
        got = group_of(x)
        assert len(set(got) - {-1}) == 1 and (got[n:] >= 0).mean() > 0.97 and (got[:n] >= 0).mean() < 0.02


def test_more_cells_than_are_broadcast(spark, data, monkeypatch):
    df = spark.createDataFrame(data, SCHEMA)
    want = rows(clusters.members(df, "plate", "label", AXES))
    monkeypatch.setattr(clusters, "BROADCAST_ROWS", 3)
    assert rows(clusters.members(df, "plate", "label", AXES)) == want
