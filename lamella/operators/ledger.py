"""Joins of the reference ledgers into the views that the interface serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import scalars as S

SEMANTICS = "REFERENCE_UNUSUALNESS_ONLY"
PLATE_COLUMNS = (
    "plate_id",
    "reference_anomaly_score_0_1",
    "status",
    "heuristic_morphology_v0",
    "response_area_fraction",
    "component_count",
    "largest_elongation",
    "hue_mean",
    "dinov2_reference_anomaly_score_0_1",
)


def left_join_named(left: DataFrame, right: DataFrame, key: str, suffix: str = "_feature") -> DataFrame:
    """Left join on ``key``; columns of the right side whose names clash get ``suffix``."""
    renamed = {c: c + suffix for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(renamed), key, "left")


def cleaned(df: DataFrame, keep_infinite: bool = False) -> DataFrame:
    """NaN as null in every floating column, and infinities too unless ``keep_infinite``."""
    fix = S.nan_to_null if keep_infinite else S.finite_or_null
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: fix(F.col(c)) for c in floating})


def picture_url(folder: str, name: Column) -> Column:
    return F.concat(F.lit(f"/static/{folder}/"), name, F.lit(".png"))


def reference_plates(scores: DataFrame, features: DataFrame, index: DataFrame, keep: tuple[str, ...] = PLATE_COLUMNS, fused: DataFrame | None = None) -> DataFrame:
    """Scored plates with their features and embedding score, the kept columns only, numbers cleaned, and where the picture is.

    Plates without features or embedding stay, with nulls. Of the index only the two needed columns take part, and of ``fused`` (a ledger of scores
    with ``plate_id``, joined last) all but its status.
    """
    joined = left_join_named(scores, features, "plate_id")
    joined = joined.join(index.select("plate_id", "dinov2_reference_anomaly_score_0_1"), "plate_id", "left")
    joined = joined.select(*keep)
    if fused is not None:
        joined = joined.join(fused.drop("status"), "plate_id", "left")
    out = cleaned(joined)
    return out.withColumns({"image_url": picture_url("plates", F.col("plate_id")), "score_semantics": F.lit(SEMANTICS)})


def pair_records(pairs: DataFrame, key: str = "bilateral_pair_id") -> DataFrame:
    """Scored pairs with cleaned numbers, where the panel is, and the guardrails."""
    return cleaned(pairs).withColumns({"panel_url": picture_url("bilateral", F.col(key)), "score_semantics": F.lit(SEMANTICS), **S.guardrails()})
