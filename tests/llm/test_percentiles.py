import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import percentiles
from lamella.llm.percentiles import RankSketch


def exact(v, share):
    v = np.sort(v)
    return v[max(1, math.ceil(share * len(v) - 1e-9)) - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1), max_size=40), max_size=5), st.booleans(), st.floats(0.01, 1))
def test_small_sketches_are_exact(parts, high, share):
    total = RankSketch(high)
    for p in parts:
        own = RankSketch(high)
        own.update(np.array(p))
        total.merge(RankSketch.from_bytes(own.to_bytes()))
    v = [x for p in parts for x in p]
    assert total.n == len(v)
    assert total.quantile(share) == (exact(v, share) if v else None)


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "ties"])
@pytest.mark.parametrize("high", [False, True])
def test_rank_error(kind, high):
    rng = np.random.default_rng(0)
    v = rng.random(300_000)
    v = {"random": v, "rising": np.sort(v), "falling": np.sort(v)[::-1], "ties": np.round(v, 3)}[kind]
    whole = RankSketch(high)
    for part in np.array_split(v, 37):
        own = RankSketch(high, seed=1)
        for chunk in np.array_split(part, 3):
            own.update(chunk)
        whole.merge(RankSketch.from_bytes(own.to_bytes()))
    assert whole.n == len(v) == sum(len(b) << i for i, b in enumerate(whole.levels))
    assert len(whole.to_bytes()) < 120_000
    s = np.sort(v)
    for p in (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999):
        q = whole.quantile(p)
        low, up = np.searchsorted(s, q, "left") / len(s), np.searchsorted(s, q, "right") / len(s)
        off = max(0, low - p, p - up)
        assert off <= 0.01 * (1 - p if high else p) + 1e-5, (p, off)


def test_spark(spark):
    rng = np.random.default_rng(1)
    data = [("a", f"d{i % 3}", float(v), "x", 0) for i, v in enumerate(rng.random(4_000))] + [("b", "d0", 0.5, "x", 0)] * 7
    data += [(None, "d0", 0.25, "x", 0), ("a", "d0", None, "x", 0), ("a", "d0", math.nan, "x", 0), ("c", "d0", math.inf, "x", 0)]
    df = spark.createDataFrame(data, "g string, day string, v double, sketch string, n int")
    whole = percentiles.sketch(df, ["g"], "v")
    days = percentiles.merge_sketches(percentiles.sketch(df, ["g", "day"], "v").drop("day"), ["g"])
    v = {k: [d[2] for d in data if d[0] == k and d[2] is not None and math.isfinite(d[2])] for k in ("a", "b", None)}
    for s in (whole, days):
        got = {(r["g"], r["percentile"]): r for r in percentiles.percentiles(s, ["g"], [1, 50, 99]).collect()}
        assert {k for k, _ in got} == {"a", "b", None}
        for (g, p), r in got.items():
            assert r["n"] == len(v[g])
            rank = (np.array(v[g]) <= r["value"]).mean()
            assert rank >= p / 100 - 0.005 and (np.array(v[g]) < r["value"]).mean() <= p / 100 + 0.005
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), ["g"], "v"), ["g"], [50]).count() == 0
