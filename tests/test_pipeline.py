import json

import numpy as np
import pytest

from lamella.api import Engine
from lamella.operators import analysis
from lamella.raster import png
from lamella.raster.plates import FEATURES
from lamella.sources import ledgers
from lamella.streaming import uploads
from pyspark.sql import functions as F
from tests.conftest import rows
from tests.test_raster import disk_plate


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    for name, img in {
        "left one.png": disk_plate(bgr=(0, 200, 0)),
        "right.png": disk_plate(bgr=(0, 0, 200)),
        "gray.png": disk_plate()[..., 1],
        "alpha.png": np.dstack([disk_plate(), np.full((256, 256), 255, np.uint8)]),
    }.items():
        (folder / name).write_bytes(png.encode(img))
    (folder / "broken.png").write_bytes(b"no image")
    (folder / "empty.png").write_bytes(b"")
    return str(folder)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledgers")
    rng = np.random.default_rng(0)
    data = [(f"r{i:02d}", *[int(9 * v) if n in analysis.plates.COUNTS else float(v) for n, v in zip(FEATURES, rng.random(18))], "mixed", "UNASSIGNED") for i in range(26)]
    ledgers.write_ledger(spark.createDataFrame(data, ledgers.PLATE_FEATURES), f"{folder}/features")
    near = '[{"plate_id":"r01","cosine_distance":0.5}]'
    scores = [(f"r{i:02d}", i / 26, 1.0, near, None, "REFERENCE_ONLY", "mixed") for i in range(26)]
    ledgers.write_ledger(spark.createDataFrame(scores, ledgers.PLATE_SCORES), f"{folder}/scores")
    ledgers.write_ledger(spark.createDataFrame([("r01", 0, 0.25)], ledgers.EMBEDDING_INDEX), f"{folder}/index")
    (folder / "manifest.json").write_text('{\n"name": "m",\n"rows": 26}')
    return Engine(spark, {n: f"{folder}/{n}" for n in ("features", "scores", "index")} | {"manifest": f"{folder}/manifest.json"}, "exams_api")


def test_ledgers(spark, engine):
    assert engine.health().first()["status"] == "ok"
    assert engine.model_info().first()["rows"] == 26
    first = engine.reference_plates().first()
    assert first["plate_id"] == "r25" and first["dinov2_reference_anomaly_score_0_1"] is None
    scores = ledgers.read_ledger(spark, engine.paths["scores"], ledgers.PLATE_SCORES)
    assert scores.schema["clinical_probability"].dataType.simpleString() == "double"
    parsed = scores.select(analysis.S.neighbor_list(F.col("nearest_neighbors_json"))[0]["plate_id"])
    assert {r[0] for r in parsed.collect()} == {"r01"}


def test_sources(spark, images):
    got = {r["filename"]: r for r in ledgers.read_images(spark, images).collect()}
    assert got["left one.png"]["height"] == 256
    assert got["broken.png"]["pixels"] is None and "empty.png" not in got
    assert {r["channels"] for r in got.values() if r["channels"]} == {1, 3, 4}
    assert ledgers.read_uploads(spark, images).count() == 5


def test_analysis(spark, engine, images):
    meta = [{"filename": "left one.png", "side": "L", "position": "A"}, {"filename": "right.png", "side": " right ", "position": "A"}]
    out = engine.analyze_exam(images, json.dumps(meta), "exam-1").first()["document"]
    assert out["source_images"] == 4 and out["plates_detected"] == 4 and out["bilateral_pairs_created"] == 1
    assert out["clinical_risk"] is None and out["clinical_claim"] == "NONE"
    pair = out["bilateral_analysis"][0]
    assert pair["bilateral_pair_id"] == "exam-1-BP-001" and pair["mean_common_response_hue_distance"] == 60
    plate = [s for s in out["sources"] if s["source_image"] == "right.png"][0]["plates"][0]
    assert plate["plate_id"] == "right-P01" and plate["side"] == "RIGHT" and plate["tlc_profile_id"] == "client-device-tlc-pending"
    assert plate["image_url"] == "/static/exam-1/plates/right-P01.png" and plate["response_mask_url"].endswith("right-P01_mask.png")
    assert pair["difference_url"] == "/static/exam-1/pairs/exam-1-BP-001_difference.png" and pair["right_aligned_url"].endswith("_right_aligned.png")
    assert out["model_status"] == "RESEARCH_REFERENCE_ANALYSIS"
    metrics = plate["qc"]["metrics"]
    assert all(metrics[n] == round(metrics[n], d) for n, d in analysis.METRIC_DIGITS.items()) and metrics["laplacian_variance"] > 0
    assert len(plate["nearest_reference_plates"]) == 5 and 0 <= plate["reference_anomaly_percentile"] <= 1
    stored = engine.get_exam("exam-1").first()
    assert stored["document"]["bilateral_pairs_created"] == 1
    assert "NaN" not in stored["result_json"] and json.loads(stored["result_json"])["clinical_risk"] is None
    assert engine.get_exam("none").count() == 0
    assert stored["saved_at"] == stored["created_at"] and stored["report_url"] == "/reports/exam-1"
    assert [r["exam_id"] for r in engine.list_exams(20).collect()] == ["exam-1"]
    page = engine.report_html("exam-1").first()["html"]
    assert "exam-1-BP-001" in page and "diagnosis" in page
    engine.analyze_exam(images, None, "exam-1")
    assert engine.list_exams().count() == 1 and engine.get_exam("exam-1").first()["document"]["bilateral_pairs_created"] == 0


def test_an_analysis_runs_once_and_writes_its_pictures(spark, engine, images, tmp_path):
    other = Engine(spark, engine.paths, "exams_pictures", str(tmp_path / "pictures"), str(tmp_path / "model"))
    meta = [{"filename": "left one.png", "side": "L", "position": "A"}, {"filename": "right.png", "side": "R", "position": "A"}]
    out = other.analyze_exam(images, json.dumps(meta), "exam-2")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan  # what is returned was computed before
    row = out.first()
    assert row["report_url"] == "/reports/exam-2" and row["saved_at"] == other.get_exam("exam-2").first()["saved_at"]
    for where, pictures in ((("plates",), [p for s in row["document"]["sources"] for p in s["plates"]]), (("pairs",), row["document"]["bilateral_analysis"])):
        for p in pictures:
            for name in [n for n in p.asDict() if n.endswith("_url")]:
                file = tmp_path / "pictures" / p[name].removeprefix("/static/")
                assert file.read_bytes()[:4] == b"\x89PNG", name
    assert len(list((tmp_path / "pictures" / "exam-2" / "pairs").glob("*.png"))) == 3
    assert rows(Engine(spark, {}, model=str(tmp_path / "model")).model().transform(other._ledger("features"))) == rows(other.model().transform(other._ledger("features")))


def test_bad_requests(engine, images, tmp_path):
    for bad in ("", "..", "a/b", "x y"):
        with pytest.raises(ValueError):
            engine.analyze_exam(images, None, bad)
    with pytest.raises(ValueError):
        engine.analyze_exam(images, "{}", "ok")


def test_unreadable(spark, images):
    assert rows(analysis.unreadable(ledgers.read_images(spark, images), ledgers.read_uploads(spark, images))) == [("broken.png",)]


def test_thresholds_of_a_profile(spark, images):
    found = analysis.extract_plates(ledgers.read_images(spark, images).where("filename = 'right.png'"))
    area = lambda df: analysis.measure_plates(df).select("signal_features.response_area_fraction").first()[0]
    assert area(found) > 0
    assert area(found.withColumns({"saturation_threshold": F.lit(255), "value_threshold": F.lit(None).cast("int")})) == 0


def test_pictures(spark, images, tmp_path):
    found = analysis.measure_plates(analysis.extract_plates(ledgers.read_images(spark, images)))
    analysis.write_pictures(found, "filename", "mask_png", str(tmp_path / "out"))
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == 4 and (tmp_path / "out" / files[0]).read_bytes()[:4] == b"\x89PNG"


def test_streams(spark, tmp_path, images):
    for n, plates in enumerate((1, 5)):
        (tmp_path / "in").mkdir(exist_ok=True)
        line = {"exam_id": "a", "created_at": f"2024-01-0{n + 1}", "plates_detected": plates, "result_json": "{}"}
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(line))
        q = uploads.append_exams(uploads.exam_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck"))
        q.awaitTermination()
    from lamella.operators import store

    assert rows(store.current(spark.read.parquet(str(tmp_path / "store"))), "exam_id", "plates_detected") == [("a", 5)]
    stream = uploads.image_stream(spark, images).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("seen").count() == 5


def test_windows_of_arrivals(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = uploads.arrivals(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").agg(F.sum("n")).first()[0] == events.count()
