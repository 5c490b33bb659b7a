"""The store of examinations: an append-only table, of which the latest row of a key counts; history, detail, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import scalars as S

COLUMNS = ("exam_id", "created_at", "analysis_type", "clinical_claim", "source_images", "plates_detected", "bilateral_pairs_created", "result_json")
HISTORY = COLUMNS[:-1]
COUNTS = ("source_images", "plates_detected", "bilateral_pairs_created")

_METRICS = T.StructType(
    [
        T.StructField(n, T.DoubleType())
        for n in ("laplacian_variance", "dark_clip_fraction", "bright_clip_fraction", "saturation_clip_fraction", "gray_dynamic_range_p95_p5")
    ]
)
_PLATE = (
    "struct<plate_id:string,qc:struct<status:string,flags:array<string>,metrics:" + _METRICS.simpleString() + ",semantics:string>,"
    "morphology_descriptor:string,reference_anomaly_percentile:double,nearest_reference_plates:array<struct<plate_id:string,cosine_distance:double>>,"
    "side:string,position:string,sequence_index:int>"
)
_PAIR = (
    "struct<bilateral_pair_id:string,position:string,left_plate_id:string,right_plate_id:string,response_jaccard_similarity:double,"
    "response_xor_fraction:double,mean_common_response_hue_distance:double,reference_asymmetry_score_0_1:double>"
)
DOCUMENT = (
    "struct<exam_id:string,analysis_type:string,source_images:int,plates_detected:int,bilateral_pairs_created:int,clinical_risk:double,clinical_claim:string,"
    f"sources:array<struct<source_image:string,extraction_mode:string,plates_detected:int,plates:array<{_PLATE}>>>,bilateral_analysis:array<{_PAIR}>>"
)


def create_table(spark: SparkSession, name: str) -> None:
    """The table of examinations, unless it exists."""
    kinds = dict.fromkeys(COUNTS, "BIGINT")
    fields = ", ".join(f"{c} {kinds.get(c, 'STRING')}" for c in COLUMNS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet")


def save(df: DataFrame, name: str) -> None:
    """Append examinations; a row replaces earlier ones of its key when the table is read by :func:`current`."""
    df.select(*COLUMNS).write.mode("append").insertInto(name)


def current(df: DataFrame, key: str = "exam_id", order: str = "created_at") -> DataFrame:
    """Of the rows of each key the one saved last; of rows saved at the same time the greatest by the other columns, in their order.

    The largest row is combined before the shuffle, so a key saved very often costs one row for each partition. A null key is a key.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c == key else F.col("_best")[c].alias(c) for c in df.columns])


def clamped(limit: int, low: int = 1, high: int = 200) -> int:
    return max(low, min(int(limit), high))


def history(df: DataFrame, order: list[str | Column], columns: list[str], limit: int = 50) -> DataFrame:
    """The newest rows without their payload: a top-n, not a sort of everything. ``limit`` is clamped to 1..200."""
    return df.select(*columns).orderBy(*order).limit(clamped(limit))


def detail(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; the filter reaches the scan. No row if there is none."""
    return df.where(F.col(key) == F.lit(value))


def parsed(df: DataFrame, text: str = "result_json") -> DataFrame:
    """``df`` with the stored document as ``document``; null for text that is none."""
    return df.withColumn("document", F.from_json(text, DOCUMENT))


def _plate_block(p: Column) -> Column:
    flags = S.joined_or(p["qc"]["flags"])
    return F.concat(
        F.lit("<section class='plate'><h3>"), S.html_escape(F.coalesce(p["plate_id"], F.lit(""))),
        F.lit("</h3><p>Morphology: "), S.html_escape(F.coalesce(p["morphology_descriptor"], F.lit(""))),
        F.lit("</p><p>Reference percentile: "), S.fixed(F.coalesce(p["reference_anomaly_percentile"], F.lit(0.0))),
        F.lit("</p><p>Quality: "), S.html_escape(F.coalesce(p["qc"]["status"], F.lit(""))), F.lit(" ("), S.html_escape(flags), F.lit(")</p></section>"),
    )


def _pair_block(p: Column) -> Column:
    return F.concat(
        F.lit("<section class='pair'><h3>"), S.html_escape(F.coalesce(p["bilateral_pair_id"], F.lit(""))),
        F.lit("</h3><p>"), S.html_escape(F.concat_ws(" / ", p["left_plate_id"], p["right_plate_id"])),
        F.lit("</p><p>Asymmetry: "), S.fixed(F.coalesce(p["reference_asymmetry_score_0_1"], F.lit(0.0))), F.lit("</p></section>"),
    )


def report_html(document: Column) -> Column:
    """A page on an examination, made beside the data; every text in it is escaped."""
    plates = F.flatten(F.transform(F.coalesce(document["sources"], F.array()), lambda s: F.coalesce(s["plates"], F.array())))
    pairs = F.coalesce(document["bilateral_analysis"], F.array())
    blocks = F.concat_ws("", F.transform(plates, _plate_block))
    pair_blocks = F.coalesce(F.nullif(F.concat_ws("", F.transform(pairs, _pair_block)), F.lit("")), F.lit("<p>No bilateral pairs.</p>"))
    return F.concat(
        F.lit("<!doctype html><html><head><meta charset='utf-8'><title>Report "), S.html_escape(document["exam_id"]), F.lit("</title></head><body><h1>"),
        S.html_escape(document["exam_id"]), F.lit("</h1><p>Unusualness relative to reference data. Not a diagnosis.</p>"), blocks, pair_blocks, F.lit("</body></html>"),
    )
