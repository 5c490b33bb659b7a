import html
import math
from datetime import datetime
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lamella.functions import scalars as S


def one(spark, column, **values):
    """A column's value over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0] if values else spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("v,clean,nan,zero", [(1.5, 1.5, 1.5, 1.5), (math.nan, None, None, 0.0), (math.inf, None, math.inf, 0.0), (None, None, None, 0.0)])
def test_cleaning(spark, v, clean, nan, zero):
    c = F.lit(v).cast("double")
    assert [one(spark, f(c)) for f in (S.finite_or_null, S.nan_to_null, S.number_or_zero)] == [clean, nan, zero]


def test_text_is_no_number(spark):
    assert one(spark, S.number_or_zero(F.lit("x"))) == 0.0


@pytest.mark.parametrize("v,side", [("L", "LEFT"), ("left", "LEFT"), (" RIGHT \n", "RIGHT"), ("x", "UNKNOWN"), (None, "UNKNOWN")])
def test_side(spark, v, side):
    assert one(spark, S.normalized_side(F.lit(v).cast("string"))) == side


@pytest.mark.parametrize("name,want", [("d/a b.v1.png", "a_b.v1-P03"), ("x" * 40 + ".png", "x" * 24 + "-P03"), (".hidden", ".hidden-P03"), ("noext", "noext-P03")])
def test_plate_name(spark, name, want):
    assert one(spark, S.plate_name(F.lit(name), F.lit(3))) == want


@pytest.mark.parametrize("text", ["a & b", "<b>\"'&amp;", "", "ß∕é"])
def test_escapes(spark, text):
    assert one(spark, S.html_escape(F.lit(text))) == html.escape(text)
    assert one(spark, S.url_component(F.lit(text))) == quote(text, safe="*-._").replace("~", "%7E")


def test_ids(spark):
    assert one(spark, S.path_safe(F.lit("a/b\\c"))) == "a_b_c"
    assert one(spark, S.path_safe(F.lit(".."))) == "__"
    assert len(one(spark, S.short_id())) == 10


def test_circles(spark):
    def iou(*c):
        return one(spark, S.circle_iou(*[F.lit(float(v)) for v in c]))

    assert iou(0, 0, 1, 3, 0, 1) == 0
    assert iou(0, 0, 2, 0, 0, 2) == pytest.approx(1)
    assert iou(0, 0, 2, 0.5, 0, 1) == pytest.approx(0.25)
    d, r = 1.0, 1.0
    lens = 2 * r * r * math.acos(d / 2 / r) - d / 2 * math.sqrt(4 * r * r - d * d)
    assert iou(0, 0, 1, 1, 0, 1) == pytest.approx(lens / (2 * math.pi - lens))


def test_scores(spark):
    assert one(spark, S.hue_distance(F.lit(170), F.lit(10))) == 20
    s = S.asymmetry_score(F.lit(0.2), F.lit(-0.1), F.lit(0.5), F.lit(None).cast("double"))
    assert one(spark, s) == pytest.approx(0.45 * 0.2 + 0.25 * 0.1 + 0.2 * 0.5)
    assert one(spark, S.asymmetry_score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.2)


@pytest.mark.parametrize(
    "numbers,label",
    [
        ((0.01, 9, 0.01, 9, 9), "minimal-response"),
        ((0.10, 5, 0.11, 9, 9), "scattered"),
        ((0.10, 1, 0.09, 3.0, 9), "linear-like"),
        ((0.25, 1, 0.20, 1.6, 8), "branched/complex"),
        ((0.30, 1, 0.20, 1.5, 8), "diffuse/large-region"),
        ((0.10, 1, 0.08, 1.0, 0), "focal/irregular-region"),
        ((0.10, 1, 0.07, 1.0, 0), "mixed"),
    ],
)
def test_morphology(spark, numbers, label):
    assert one(spark, S.morphology(*[F.lit(float(n)) for n in numbers])) == label


def test_quality(spark):
    flags = S.qc_flags(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0, 0.0, 0.0)])
    assert one(spark, flags) == ["LOW_SHARPNESS", "VERY_DARK_PLATE", "LOW_CONTRAST", "VERY_LOW_THERMOCHROMIC_RESPONSE"]
    assert one(spark, S.qc_status(flags)) == "REJECT_REFERENCE_QC"
    fine = S.qc_flags(*[F.lit(v) for v in (20.0, 0.08, 0.85, 0.20, 12.0, 0.005)])
    assert one(spark, fine) == [] and one(spark, S.qc_status(fine)) == "PASS_REFERENCE_QC"
    assert one(spark, S.qc_status(F.array(F.lit("LOW_SHARPNESS")))) == "REVIEW"


def test_strict_json(spark):
    df = spark.createDataFrame([(1.0, None), (math.nan, "x")], "a double, b string")
    text = S.strict_json(F.struct("a", "b"), F.col("a"))
    assert df.where('a = 1').select(text).first()[0] == '{"a":1.0,"b":null}'
    with pytest.raises(Exception, match="range of JSON"):
        df.select(text).collect()


@pytest.mark.parametrize(
    "text,names",
    [('[{"filename": "a"}]', ["a"]), ('{"files": [{"filename": "b", "side": 3}]}', ["b"]), ('{"x": 1}', None), ("7", None), ("no", None), ("", None), (None, None), ('{"files": null}', None)],
)
def test_upload_items(spark, text, names):
    got = one(spark, S.upload_items(F.lit(text).cast("string")))
    assert (got and [g["filename"] for g in got]) == names


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, S.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, S.unit(a)) == [0.6, 0.8]
    assert one(spark, S.pair_vector(a, b)) == [3, 4, 4, 3, 1, 1, 12, 12]


def test_time(spark):
    assert one(spark, S.iso_utc(F.lit(datetime(2024, 1, 2, 3, 4, 5, 6)).cast("timestamp_ntz"))) == "2024-01-02T03:04:05.000006+00:00"
