import math

import numpy as np
import pytest

from lamella.llm import cutoffs
from tests.conftest import rows

SCORES = "g long, id string, s double, n string, cutoff string"


def brute(scores, targets):
    out = {}
    for g, f in targets.items():
        v = sorted((s for k, s in scores if k == g), reverse=True)
        if v and f > 0:
            need = max(1, math.ceil(min(f, 1) * len(v) - 1e-9))
            out[g] = (v[need - 1], len(v), sum(s >= v[need - 1] for s in v))
    return out


def run(spark, scores, targets, bins=cutoffs.BINS):
    df = spark.createDataFrame([(g, f"r{i}", s, "x", "y") for i, (g, s) in enumerate(scores)], SCORES)
    usable = cutoffs.usable_scores(df, "g", "s")
    t = spark.createDataFrame(list(targets.items()), "g long, f double")
    got = cutoffs.refine_cutoffs(usable, t, "g", "s", "f", bins)
    kept = cutoffs.keep_above(usable, got, "g", "s")
    assert kept.columns[:2] == ["g", "id"]
    by = {r["g"]: (r["cutoff"], r["n"], r["kept"]) for r in got.collect()}
    counts = {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()}
    assert counts == {g: v[2] for g, v in by.items()}
    return by


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_against_sorting(spark, bins):
    rng = np.random.default_rng(0)
    scores = [(0, float(s)) for s in rng.random(900)]  # a hot group
    scores += [(1, float(s)) for s in rng.integers(0, 4, 200) / 3]  # many ties
    scores += [(2, 0.5)] * 50 + [(3, 0.25)] + [(4, 0.0), (4, 1.0)]
    scores += [(5, float(np.nextafter(0.5, i))) for i in (0, 1)] * 5 + [(5, 0.5)] * 3
    scores += [(6, s) for s in (math.nan, math.inf, -0.1, 1.1)]
    targets = {0: 0.3, 1: 0.5, 2: 0.1, 3: 1.0, 4: 0.5, 5: 0.4, 6: 0.5, 7: 0.5}
    good = [(g, s) for g, s in scores if 0 <= s <= 1]
    assert run(spark, scores, targets, bins) == brute(good, targets)


def test_fractions(spark):
    scores = [(g, i / 30) for g in range(6) for i in range(30)]
    targets = {0: 0.1, 1: 2.0, 2: 0.0, 3: -1.0, 4: math.nan, 5: None}
    got = run(spark, scores, targets)
    assert {g: v[2] for g, v in got.items()} == {0: 3, 1: 30}


def test_nulls_and_empty_tables(spark):
    assert run(spark, [], {0: 0.5}) == {}
    assert run(spark, [(None, 0.5), (1, None)], {1: 0.5}) == {}
    df = spark.createDataFrame([(1, "a", 0.5, "", "")], SCORES)
    none = spark.createDataFrame([], "g long, f double")
    assert rows(cutoffs.refine_cutoffs(df, none, "g", "s", "f")) == []
    twice = spark.createDataFrame([(1, 0.2), (1, 0.9), (None, 0.5)], "g long, f double")
    assert cutoffs.refine_cutoffs(df, twice, "g", "s", "f").count() == 1
