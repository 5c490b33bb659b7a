import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.model import reference as M
from lamella.operators import ledger, pairing, quantiles, store, vectors
from lamella.plans import aggregates
from lamella.raster import shapes
from lamella.sources import ledgers
from tests.conftest import rows


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    x[:, 5] = 1.0  # no spread
    x[7] += 12
    data = [(f"p{i:02d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "plate_id string, a double, b double, c double, d double, e double, f double")


COLUMNS = list("abcdef")


def test_robust_scaling(spark, corpus):
    x = np.array(corpus.orderBy("plate_id").select(*COLUMNS).collect())
    q1, m, q3 = np.percentile(x, [25, 50, 75], axis=0)
    want = (x - m) / np.where(q3 > q1, q3 - q1, 1)
    got = np.array(M.robust_scaled(corpus, COLUMNS).orderBy("plate_id").select(*COLUMNS).collect())
    assert np.allclose(got, want)


def test_model(spark, corpus):
    model = M.ReferenceModel.fit(corpus, "plate_id", COLUMNS, trees=60)
    assert model.axes.shape[0] == 6 and np.allclose(model.corpus.mean(0), 0)
    odd = corpus.withColumn("a", F.when(F.col("plate_id") == "p00", math.nan).otherwise(F.col("a")))
    out = {r["plate_id"]: r for r in model.transform(odd).collect()}
    assert out["p07"]["reference_anomaly_percentile"] == 1.0
    levels = {round(i / 40, 6) for i in range(41)}
    assert all(r["reference_anomaly_percentile"] in levels for r in out.values())
    near = out["p03"]["nearest_reference_plates"]
    assert len(near) == 5 and near[0]["plate_id"] == "p03" and near[0]["cosine_distance"] == 0
    assert [n["cosine_distance"] for n in near] == sorted(n["cosine_distance"] for n in near)


def test_model_needs_rows(spark, corpus):
    with pytest.raises(ValueError):
        M.ReferenceModel.fit(corpus.limit(2), "plate_id", COLUMNS)


def test_forest_tells_outliers():
    x = np.vstack([np.random.default_rng(0).normal(size=(200, 3)), [[9, 9, 9]]])
    s = M.Forest.fit(x, trees=100).score(x)
    assert s.argmax() == 200 and 0 < s.min() and s.max() < 1
    same = M.Forest.fit(np.zeros((5, 2)), trees=3).score(np.zeros((5, 2)))
    assert np.allclose(same, same[0])


def test_empirical_percentile(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    df = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in M.empirical_percentile(df, F.col("x"), ref, F.col("v"), "p").select("p").collect()] == [0.0, 1.0, 1.0, None]
    assert M.empirical_percentile(df, F.col("x"), ref.limit(0), F.col("v"), "p").select("p").first()[0] is None


def test_nearest_reference(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).round(3)
    x[10] = x[11] = x[12]
    x[20] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, v array<double>")
    u = np.delete(x, 20, 0) / np.linalg.norm(np.delete(x, 20, 0), axis=1)[:, None]
    names = np.delete(np.arange(60), 20)
    far = np.round(np.maximum(1 - u @ u.T, 0), 9)
    np.fill_diagonal(far, 9)
    want = [(int(names[i]), k + 1, int(names[j])) for i in range(59) for k, j in enumerate(np.lexsort((names, far[i]))[:3])]
    for block in (7, 1_000):
        got = vectors.nearest_reference(df, df, "id", "v", k=3, block=block)
        assert rows(got, "id", "rank", "neighbor") == sorted(want, key=repr)
    assert vectors.nearest_reference(df, df.limit(0), "id", "v").count() == 0


def test_ledger_join(spark):
    scores = spark.createDataFrame([("a", 0.5, "s", "x"), ("b", math.nan, "s", "x")], "plate_id string, reference_anomaly_score_0_1 double, status string, heuristic_morphology_v0 string")
    features = spark.createDataFrame([("a", math.inf, "y")], "plate_id string, response_area_fraction double, heuristic_morphology_v0 string")
    joined = ledger.left_join_named(scores, features, "plate_id")
    assert joined.columns[-1] == "heuristic_morphology_v0_feature"
    got = rows(ledger.cleaned(joined), "plate_id", "reference_anomaly_score_0_1", "response_area_fraction")
    assert got == [("a", 0.5, None), ("b", None, None)]
    assert rows(ledger.cleaned(joined, True), "plate_id", "response_area_fraction") == [("a", math.inf), ("b", None)]


def test_pairing(spark):
    data = [("p", "LEFT", 2, "a"), ("p", "LEFT", 1, "b"), ("p", "RIGHT", 0, "c"), ("q", "LEFT", 1, "d"), ("p", "UNKNOWN", 0, "e"), (None, "LEFT", 1, "f"), (None, "RIGHT", 1, "g")]
    df = spark.createDataFrame(data, "position string, side string, seq int, id string")
    got = pairing.zip_pairs(df, ["position"], "side", "LEFT", "RIGHT", ["seq", "id"], ["id"])
    assert rows(got) == sorted([("p", 1, "b", "c"), (None, 1, "f", "g")], key=repr)
    assert pairing.zip_pairs(df.limit(0), ["position"], "side", "LEFT", "RIGHT", ["seq"], ["id"]).count() == 0


def test_upload_lookup(spark):
    text = json.dumps([{"filename": "a", "side": "l", "sequence_index": "0"}, {"side": "R"}, {"filename": "a", "side": "R", "sequence_index": "x", "position": ""}])
    got = pairing.upload_lookup(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (got["side"], got["position"], got["sequence_index"]) == ("RIGHT", "", None)


def test_store(spark):
    store.create_table(spark, "exams_t")
    store.create_table(spark, "exams_t")
    def row(i, at, plates):
        doc = {"exam_id": i, "sources": [{"plates": [{"plate_id": "<p>", "qc": {"status": "PASS", "flags": []}, "reference_anomaly_percentile": 0.5}]}], "bilateral_analysis": []}
        return (i, at, "t", "NONE", 1, plates, 0, json.dumps(doc))
    for data in ([row("a", "2024-01-01", 1), row("b", "2024-01-02", 1)], [row("a", "2024-01-03", 9)]):
        store.save(spark.createDataFrame(data, "exam_id string, created_at string, analysis_type string, clinical_claim string, source_images long, plates_detected long, bilateral_pairs_created long, result_json string"), "exams_t")
    latest = store.current(spark.table("exams_t"))
    assert rows(latest, "exam_id", "plates_detected") == [("a", 9), ("b", 1)]
    assert [r[0] for r in store.history(latest, [F.desc("created_at")], ["exam_id"], 0).collect()] == ["a"]
    assert store.clamped(999) == 200
    page = store.parsed(store.detail(latest, "exam_id", "a")).select(store.report_html(F.col("document"))).first()[0]
    assert "&lt;p&gt;" in page and "No bilateral pairs" in page and "0.500" in page and "(None)" in page
    assert store.detail(latest, "exam_id", "zz").count() == 0
    plan = store.detail(spark.table("exams_t"), "exam_id", "a").select("plates_detected")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(exam_id,a)" in plan and "result_json" not in plan


def test_reference_queries_use_all_components(spark, tmp_path):
    """Vectors that differ only in the last components: these explain the variance and rank the odd one out highest."""
    rng = np.random.default_rng(3)
    x = np.hstack([np.full((40, 40), 0.1), rng.normal(size=(40, 24))])
    x[-1, 40:] += 50
    rows_in = [(i, int(i == 39), [float(v) for v in row]) for i, row in enumerate(x)]
    spark.createDataFrame(rows_in, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    explained = [r["explained"] for r in aggregates.q62_pca_scores(spark, str(tmp_path)).collect()]
    assert len(explained) == 8 and min(explained) > 0.01
    score = {r["plate_id"]: r["reference_anomaly_percentile"] for r in aggregates.q63_iforest_percentile(spark, str(tmp_path)).collect()}
    assert len(score) == 40 and score["39"] == 1.0 and min(score.values()) < 0.1


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(3, 2, 5_000), "b": np.round(rng.normal(0, 3, 400)), "c": np.array([7.0]), "d": np.array([-1e300, 1e300, 1.0, 1.0 + 1e-15]), None: rng.random(50)}
    data = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [("a", None, "x"), ("a", math.nan, "x"), ("e", math.inf, "x")]
    df = spark.createDataFrame(data, "g string, v double, n string")
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["g"]: r["p"] for r in quantiles.exact_percentiles(df, ["g"], F.col("v"), shares, "p").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = np.sort(vs)
        at = np.array(shares) * (len(s) - 1)
        low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        assert got[k] == pytest.approx((low + (at - np.floor(at)) * (high - low)).tolist(), rel=1e-15)
    one = quantiles.exact_percentiles(df.where("g = 'b'"), [], F.col("v"), [0.25])
    assert one.columns == ["percentiles"] and one.first()[0][0] == np.percentile(groups["b"], 25)
    assert quantiles.exact_percentiles(df.limit(0), ["g"], F.col("v"), [0.5]).count() == 0


def test_percentile_among_many_values(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_REFERENCE", 20)
    rng = np.random.default_rng(2)
    ref = np.r_[rng.normal(size=300).round(2), np.full(150, 0.5)]
    asked = np.r_[rng.normal(size=200).round(2), np.full(100, 0.5), -9, 9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(asked)] + [(-1, None), (-2, math.nan)], "v long, x double")
    other = spark.createDataFrame([(float(v),) for v in ref] + [(None,), (math.nan,)], "v double")
    got = {r["v"]: r["p"] for r in M.empirical_percentile(df, F.col("x"), other, F.col("v"), "p").collect()}
    assert got.pop(-1) is None and got.pop(-2) is None and len(got) == len(asked)
    assert all(got[i] == pytest.approx((ref <= v).mean()) for i, v in enumerate(asked))


def test_model_is_stored_and_bounded(spark, corpus, tmp_path, monkeypatch):
    model = M.ReferenceModel.fit(corpus, "plate_id", COLUMNS, trees=40)
    model.save(spark, str(tmp_path / "m"))
    model.save(spark, str(tmp_path / "m"))
    again = M.ReferenceModel.load(spark, str(tmp_path / "m"))
    assert rows(again.transform(corpus)) == rows(model.transform(corpus))
    monkeypatch.setattr(M, "DISTANCES", 100)  # two rows at a time
    assert rows(again.transform(corpus)) == rows(model.transform(corpus))
    few = M.ReferenceModel.fit(corpus, "plate_id", COLUMNS, trees=10, bound=25)
    assert len(few.names) == 25 and few.names == M.ReferenceModel.fit(corpus.repartition(7), "plate_id", COLUMNS, trees=10, bound=25).names
    with pytest.raises(ValueError):
        M.ReferenceModel.load(spark, _empty_model(spark, tmp_path))


def _empty_model(spark, tmp_path):
    spark.createDataFrame([], "head string, arrays binary").write.parquet(str(tmp_path / "none"))
    return str(tmp_path / "none")


def test_overlaps_of_wide_circles(spark):
    """The grid follows the data: no pair is lost, however large a circle is, and each image has its own cells."""
    rng = np.random.default_rng(4)
    data = [("a", i, *map(float, rng.random(2) * 900), float(rng.choice([3, 40, 300])), float(i % 5)) for i in range(80)]
    data += [("b", 100 + i, *map(float, rng.random(2) * 9), 1.0, 1.0) for i in range(30)] + [("c", 200, 1.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(data, "g string, id long, x double, y double, r double, score double")
    want = [(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and shapes.circle_overlap(*a[2:5], *b[2:5]) > 0]
    assert rows(pairing.overlapping_circles(df, "g"), "g", "id_a", "id_b") == sorted(want, key=repr)
    kept = []
    for c in sorted(data, key=lambda c: (c[0], -c[5], c[1])):
        if all(k[0] != c[0] or shapes.circle_overlap(*k[2:5], *c[2:5]) < 0.35 for k in kept):
            kept.append(c)
    assert rows(pairing.greedy_circles(df, ["g"])) == sorted(kept, key=repr)


def test_overlaps_of_circles_in_one_place(spark, monkeypatch):
    """Lists of equal circles and divided cells give each pair once, whatever is repeated or null."""
    monkeypatch.setattr(pairing, "SAME_CIRCLES", 3)
    monkeypatch.setattr(pairing, "CELL_ROWS", 4)
    rng = np.random.default_rng(5)
    data = [(g, i, float(i * 7 % 5), float(i * 3 % 4), float(rng.integers(0, 4))) for i, g in enumerate("a" * 70 + "b" * 9)]
    data += [("a", 7, 1.0, 1.0, 2.0), ("a", 200, None, 1.0, 2.0), ("a", None, 1.0, 1.0, 2.0), (None, 201, 1.0, 1.0, 2.0), (None, 202, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, id long, x double, y double, r double")
    whole = [c for c in data if None not in c]
    over = [(a[0], a[1], b[1], shapes.circle_overlap(*a[2:5], *b[2:5])) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1]]
    got = rows(pairing.overlapping_circles(df, "g"), "g", "id_a", "id_b", "iou")
    want = sorted((p for p in over if p[3] > 0), key=repr)
    assert [p[:3] for p in got] == [p[:3] for p in want] and np.allclose([p[3] for p in got], [p[3] for p in want], atol=1e-12)
    few = rows(pairing.overlapping_circles(df, "g", digits=0), "g", "id_a", "id_b", "iou")
    assert few == sorted(((*p[:3], round(p[3], 0)) for p in want if round(p[3], 0) > 0), key=repr) and len(few) < len(want)


def test_work_on_overlaps_is_spread(spark):
    """A small table has many pairs: they are compared in many tasks, and an overlap is computed once only."""
    circles = [F.col("id") % 37.0, F.col("id") % 41.0, F.col("id") % 5 + 1.0]
    df = spark.range(0, 300, 1, 1).select((F.col("id") % 2).alias("g"), "id", *[c.alias(n) for c, n in zip(circles, "xyr")])
    pairs = pairing.overlapping_circles(df, "g")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("ACOS") == 2  # two angles
    assert pairs.select(F.spark_partition_id()).distinct().count() > 2


def test_last_wins_and_current_tell_ties_apart(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", None, None)], "k string, at int, v string")
    assert rows(pairing.last_wins(df, ["k"], ["at"])) == [("a", 1, "y"), ("b", None, "z")]
    assert rows(store.current(df, "k", "at")) == [("a", 1, "y"), ("b", None, "z")]
    assert store.current(df, "k", "at").columns == ["k", "at", "v"]


def test_numbers_of_all_kinds_in_a_ledger(spark, tmp_path):
    data = [("a", math.nan, 'x "y"\n'), ("b", math.inf, ""), ("c", -math.inf, None), ("d", None, " z "), ("e", 0.1, "\\N?")]
    columns = ledgers.schema("k:s v:d t:s")
    ledgers.write_ledger(spark.createDataFrame(data, columns), str(tmp_path / "l"), null="\\N")
    back = ledgers.read_ledger(spark, str(tmp_path / "l"), columns, null="\\N")
    assert repr(rows(back)) == repr(sorted(data, key=repr))


def test_matrix_files(spark, tmp_path):
    x = np.random.default_rng(0).random((7, 5))
    np.save(tmp_path / "m.npy", x)
    got = rows(ledgers.read_matrix(spark, str(tmp_path / "m.npy")))
    assert [r[0] for r in got] == list(range(7)) and np.allclose([r[1] for r in got], x)
    np.save(tmp_path / "flat.npy", x[0])
    with pytest.raises(Exception, match="matrix"):
        ledgers.read_matrix(spark, str(tmp_path / "flat.npy")).collect()


def test_nearest_reference_on_ties(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(30)], "id long, v array<double>")
    want = [(i, k + 1, j) for i in range(30) for k, j in enumerate([j for j in range(30) if j % 2 == i % 2 and j != i][:4])]
    for block in (4, 100):
        assert rows(vectors.nearest_reference(df, df, "id", "v", k=4, block=block), "id", "rank", "neighbor") == sorted(want, key=repr)
