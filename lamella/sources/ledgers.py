"""Readers of ledgers (CSV), documents (JSON), files and images, all with declared schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType()}


def schema(spec: str) -> T.StructType:
    """A schema from ``name:kind`` words; kinds are s(tring), d(ouble), l(ong), i(nteger), b(oolean)."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (w.split(":") for w in spec.split())])


PLATE_SCORES = schema("plate_id:s reference_anomaly_score_0_1:d embedding_norm:d nearest_neighbors_json:s clinical_probability:d status:s heuristic_morphology_v0:s")
PLATE_FEATURES = schema(
    "plate_id:s response_area_fraction:d component_count:l largest_component_fraction:d largest_eccentricity:d largest_solidity:d largest_perimeter_px:d"
    " largest_elongation:d skeleton_length_px:l branch_pixels:l endpoint_pixels:l response_centroid_x_norm:d response_centroid_y_norm:d hue_mean:d hue_std:d"
    " saturation_mean:d value_mean:d lab_a_mean:d lab_b_mean:d heuristic_morphology_v0:s clinical_meaning:s"
)
PAIR_FEATURES = schema(
    "bilateral_pair_id:s source_group:l left_reference_plate:s right_reference_plate:s layout_match_cost:d left_response_area_fraction:d"
    " right_response_area_fraction:d absolute_area_fraction_delta:d response_jaccard_similarity:d response_xor_fraction:d"
    " mean_common_response_hue_distance:d p90_common_response_hue_distance:d orientation_status:s clinical_interpretation:s"
)
PAIR_SCORES = T.StructType(PAIR_FEATURES.fields + schema("reference_pair_anomaly_score_0_1:d clinical_probability:d status:s").fields)
EMBEDDING_INDEX = schema("plate_id:s embedding_row:l dinov2_reference_anomaly_score_0_1:d")
FUSED_SCORES = schema("plate_id:s dinov2_lct_fused_reference_score_0_1:d status:s")
PAIR_EMBEDDING_SCORES = schema(
    "bilateral_pair_id:s left_plate_id:s right_plate_id:s dinov2_cosine_similarity:d dinov2_cosine_distance:d dinov2_pair_reference_anomaly_score_0_1:d status:s"
)


def read_ledger(spark: SparkSession, path: str, columns: T.StructType, null: str = "", empty: str = "") -> DataFrame:
    """A CSV ledger; quotes within quoted cells are doubled, so cells may hold JSON. Rows that do not fit the schema raise."""
    return spark.read.schema(columns).options(**_CSV, mode="FAILFAST", enforceSchema=False, nullValue=null, emptyValue=empty).csv(path)


#: Quotes are doubled within quotes, and blanks at the ends of cells are kept both ways.
_CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_ledger(df: DataFrame, path: str, null: str = "", empty: str = '""') -> None:
    """Write a ledger; ``null`` and ``empty`` stand for null and for empty texts, which differ unless both are the same."""
    df.write.options(**_CSV, nullValue=null, emptyValue=empty).csv(path)


def read_document(spark: SparkSession, path: str, columns: T.StructType | None = None) -> DataFrame:
    """A JSON document that spans lines, as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(columns) if columns else reader).json(path)


def _plain_path(path: Column) -> Column:
    """A path as the file system has it: one slash behind the scheme, no percent signs for blanks."""
    path = F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as they are: path, name, length, content. Empty files are left out by the source."""
    files = spark.read.format("binaryFile").load(path).withColumn("path", _plain_path(F.col("path")))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, name, height, width, number of channels, pixels; files that are no images have null pixels, empty files are left out."""
    img = spark.read.format("image").load(path).select("image.*").withColumn("path", _plain_path(F.col("origin")))
    broken = F.col("height") <= 0
    return img.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        *[F.when(~broken, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "pixels"))],
    )


def read_matrix(spark: SparkSession, path: str, index: str = "embedding_row", vector: str = "embedding") -> DataFrame:
    """A matrix in NumPy's file format: a row number from 0 and the row's cells in single precision. Files that hold no matrix of numbers raise.

    A file is one task's; of a folder each file keeps its own numbers. Only the format's plain arrays are read, never objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                matrix = np.load(io.BytesIO(data), allow_pickle=False)
                if matrix.ndim != 2 or matrix.dtype.kind not in "fiu":
                    raise ValueError("a matrix of numbers was expected")
                for a in range(0, len(matrix), 4_096):
                    rows = pa.array(list(matrix[a : a + 4_096].astype(np.float32)), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(rows), dtype=np.int64)), rows], [index, vector])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"`{index}` long, `{vector}` array<float>")


def read_vectors(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """A matrix stored with a row for each vector; its cells in single precision."""
    return spark.read.parquet(path).withColumn(vector, F.col(vector).cast("array<float>"))
