"""The analysis of an examination: images to plates, features, scores, quality, pairs, one nested document.

The image kernels run in Arrow batches beside the data; pixels stay in the table, nothing is read twice. Rows are shuffled by
position when pairs are made and by examination when the document is put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.common import cut
from lamella.functions import scalars as S
from lamella.model.reference import ReferenceModel
from lamella.operators import pairing
from lamella.raster import color, plates, png

_FEATURE_FIELDS = ",".join(f"{n}:{'int' if n in plates.COUNTS else 'double'}" for n in plates.FEATURES)
_METRIC_FIELDS = "laplacian_variance:double,dark_clip_fraction:double,bright_clip_fraction:double,saturation_clip_fraction:double,gray_dynamic_range_p95_p5:double"
#: Digits of the quality metrics.
METRIC_DIGITS = {
    "laplacian_variance": 4,
    "dark_clip_fraction": 6,
    "bright_clip_fraction": 6,
    "saturation_clip_fraction": 6,
    "gray_dynamic_range_p95_p5": 4,
}
#: Pictures of a plate and of a pair: column, ending of the file's name, member of the document with its address.
PLATE_PICTURES = (("crop_png", "", "image_url"), ("mask_png", "_mask", "response_mask_url"))
PAIR_PICTURES = (("panel_png", "", "panel_url"), ("difference_png", "_difference", "difference_url"), ("aligned_png", "_right_aligned", "right_aligned_url"))
_PAIR_FIELDS = (
    "dx:double,dy:double,response:double,left_response_area_fraction:double,right_response_area_fraction:double,absolute_area_fraction_delta:double,"
    "response_jaccard_similarity:double,response_xor_fraction:double,mean_common_response_hue_distance:double,"
    "p90_common_response_hue_distance:double,reference_asymmetry_score_0_1:double"
)


def image_array(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    return color.three_channels(np.frombuffer(pixels, np.uint8).reshape(height, width, channels))


def extract_plates(images: DataFrame) -> DataFrame:
    """A row for each plate of each readable image: ``filename``, ``extraction_mode``, ``plate_index`` (from 1), ``pixels`` at a fixed size.

    ``images`` is as read by the image source; those that are none give no rows (see :func:`unreadable`).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mode, found = plates.extract(image_array(r.height, r.width, r.channels, r.pixels))
                rows += [(r.filename, mode, i, p.tobytes()) for i, p in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["filename", "extraction_mode", "plate_index", "pixels"])

    good = images.where("pixels is not null").select("filename", "height", "width", "channels", "pixels")
    return good.mapInPandas(run, "filename string, extraction_mode string, plate_index int, pixels binary")


def unreadable(images: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploaded files that are no images. Empty files are left out by both sources."""
    good = images.where("pixels is not null").select("path")
    return uploads.select("path", "filename").join(good, "path", "left_anti").select("filename")


def measure_plates(df: DataFrame) -> DataFrame:
    """``df`` with ``signal_features``, ``metrics``, ``mask_png`` and ``crop_png`` of each plate's pixels. Thresholds may come as columns
    ``saturation_threshold`` and ``value_threshold`` (of a profile); null or absent ones take the defaults."""

    @F.pandas_udf(f"struct<features:struct<{_FEATURE_FIELDS}>,metrics:struct<{_METRIC_FIELDS}>,mask_png:binary,crop_png:binary>")
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, s, v in pdf.itertuples(index=False):
                img = np.frombuffer(data, np.uint8).reshape(plates.PLATE, plates.PLATE, 3)
                numbers, mask = plates.features(img, s, v)
                numbers = {n: int(x) if n in plates.COUNTS else x for n, x in numbers.items()}
                out.append((numbers, plates.quality(img), png.encode(mask), png.encode(img)))
            yield pd.DataFrame(out, columns=["features", "metrics", "mask_png", "crop_png"])

    def threshold(name: str, default: int) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    given = F.struct(
        "pixels", threshold("saturation_threshold", plates.SATURATION).alias("s"), threshold("value_threshold", plates.VALUE).alias("v")
    )
    out = df.withColumn("_m", measured(given))
    return out.select(*df.columns, F.col("_m.features").alias("signal_features"), "_m.metrics", "_m.mask_png", "_m.crop_png")


def compare_pairs(pairs: DataFrame, left: str = "left_pixels", right: str = "right_pixels", sign: float = 1.0) -> DataFrame:
    """``pairs`` with ``comparison`` (a struct of the pair's numbers), ``panel_png``, ``difference_png`` and ``aligned_png``."""

    @F.pandas_udf(f"struct<record:struct<{_PAIR_FIELDS}>,panel_png:binary,difference_png:binary,aligned_png:binary>")
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = (plates.PLATE, plates.PLATE, 3)
        for pdf in batches:
            out = []
            for a, b in pdf.itertuples(index=False):
                record, pictures = plates.compare(np.frombuffer(a, np.uint8).reshape(shape), np.frombuffer(b, np.uint8).reshape(shape), sign)
                out.append((record, *(png.encode(pictures[n]) for n in ("panel", "difference", "right_aligned"))))
            yield pd.DataFrame(out, columns=["record", "panel_png", "difference_png", "aligned_png"])

    out = pairs.withColumn("_c", compared(F.struct(F.col(left).alias("a"), F.col(right).alias("b"))))
    return out.select(*pairs.columns, F.col("_c.record").alias("comparison"), *[f"_c.{n}" for n, _, _ in PAIR_PICTURES])


def rounded(struct: str, names: tuple[str, ...], digits: int, counts: tuple[str, ...] = ()) -> Column:
    """A struct with its numbers rounded, counts as integers."""
    return F.struct(*[(F.col(f"{struct}.{n}").cast("int") if n in counts else F.round(F.col(f"{struct}.{n}"), digits)).alias(n) for n in names])


def scored_plates(images: DataFrame, lookup: DataFrame, model: ReferenceModel, profiles: DataFrame | None = None) -> DataFrame:
    """Every plate with its features, quality, score and place in the examination.

    ``lookup`` is upload metadata by file name (see :func:`lamella.operators.pairing.upload_lookup`); ``profiles`` may bring thresholds by ``tlc_profile_id``.
    """
    found = extract_plates(images).join(lookup, "filename", "left")
    side = F.coalesce("side", F.lit("UNKNOWN"))
    ordinal = F.row_number().over(Window.partitionBy("filename").orderBy("plate_index"))
    found = found.withColumns(
        {
            "plate_id": S.plate_name(F.col("filename"), F.col("plate_index")),
            "side": side,
            "position": S.position_or_auto(F.col("position"), ordinal),
            "sequence_index": F.coalesce("sequence_index", ordinal),
            "tlc_profile_id": F.coalesce("tlc_profile_id", F.lit(S.DEFAULT_PROFILE)),
        }
    )
    if profiles is not None:
        found = found.join(profiles.select("tlc_profile_id", "saturation_threshold", "value_threshold"), "tlc_profile_id", "left")
    measured = measure_plates(found)
    f, m = (lambda n: F.col(f"signal_features.{n}")), (lambda n: F.col(f"metrics.{n}"))
    label = S.morphology(
        f("response_area_fraction"), f("component_count"), f("largest_component_fraction"), f("largest_elongation"), f("branch_pixels")
    )
    flags = S.qc_flags(
        m("laplacian_variance"), m("bright_clip_fraction"), m("dark_clip_fraction"), m("saturation_clip_fraction"),
        m("gray_dynamic_range_p95_p5"), f("response_area_fraction"),
    )
    flat = measured.select("*", *[f(n).alias(n) for n in plates.FEATURES], label.alias("morphology_descriptor"), flags.alias("flags"))
    scored = model.transform(flat)
    return scored.withColumns(
        {
            "qc": F.struct(
                S.qc_status(F.col("flags")).alias("status"), "flags",
                F.struct(*[F.round(F.col(f"metrics.{n}"), digits).alias(n) for n, digits in METRIC_DIGITS.items()]).alias("metrics"),
                F.lit("IMAGE_QUALITY_ONLY").alias("semantics"),
            ),
            "signal_features": rounded("signal_features", plates.FEATURES, 6, plates.COUNTS),
        }
    ).drop("metrics", "flags", *plates.FEATURES)


def bilateral_pairs(scored: DataFrame, exam_id: str) -> DataFrame:
    """Left and right plates of the same position, in their order, with the comparison's numbers."""
    both = pairing.zip_pairs(scored, ["position"], "side", "LEFT", "RIGHT", ["sequence_index", "plate_id"], ["plate_id", "pixels"])
    named = pairing.pair_names(both, F.lit(exam_id), [], ["position", "ordinal"])  # the pairs of one examination
    return compare_pairs(named)


def picture_address(exam: str, kind: str, name: Column, ending: str) -> Column:
    """Where the interface finds a picture: the name under which :func:`write_pictures` stores it."""
    return F.concat(F.lit(f"/static/{exam}/{kind}/"), file_name(name, ending))


def file_name(name: Column, ending: str = "") -> Column:
    return F.concat(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"), F.lit(f"{ending}.png"))


def analyze_exam(
    images: DataFrame, metadata: DataFrame, metadata_text: str, exam_id: str, model: ReferenceModel, profiles: DataFrame | None = None, pictures: str | None = None
) -> DataFrame:
    """One row with the nested document of an examination (``exam_id``, ``document``).

    Images are decoded, measured and scored once, and pairs compared once: both are kept, as several parts of the document need them. ``pictures``
    names a folder that the executors share; the pictures are then written there (``plates`` and ``pairs``).
    """
    lookup = pairing.upload_lookup(metadata, metadata_text)
    scored = cut(scored_plates(images, lookup, model, profiles))
    plate = F.struct(
        *[picture_address(exam_id, "plates", F.col("plate_id"), e).alias(n) for _, e, n in PLATE_PICTURES],
        "plate_id", "qc", "morphology_descriptor", "signal_features", "reference_anomaly_percentile", "nearest_reference_plates",
        F.lit(None).cast("double").alias("clinical_risk"), F.lit("NONE").alias("clinical_claim"), F.col("filename").alias("source_image"),
        "side", "position", "sequence_index", "tlc_profile_id",
    )
    sources = scored.groupBy("filename").agg(
        F.first("extraction_mode").alias("extraction_mode"),
        F.count("*").cast("int").alias("plates_detected"),
        F.transform(F.array_sort(F.collect_list(F.struct("plate_index", plate.alias("p")))), lambda s: s["p"]).alias("plates"),
    )
    source = F.struct(F.col("filename").alias("source_image"), "extraction_mode", "plates_detected", "plates")
    top = sources.agg(F.array_sort(F.collect_list(source)).alias("sources"), F.coalesce(F.sum("plates_detected"), F.lit(0)).cast("int").alias("plates_detected"))
    pairs = cut(bilateral_pairs(scored, exam_id))
    if pictures:
        for frame, name, kind, own in ((scored, "plate_id", "plates", PLATE_PICTURES), (pairs, "bilateral_pair_id", "pairs", PAIR_PICTURES)):
            for column, ending, _ in own:
                write_pictures(frame, name, column, f"{pictures}/{exam_id}/{kind}", ending)
    c = lambda n: F.col(f"comparison.{n}")
    numbers = [n.split(":")[0] for n in _PAIR_FIELDS.split(",")][3:]
    pair = F.struct(
        F.struct(*[F.round(c(n), 6).alias(n) for n in ("dx", "dy", "response")]).alias("registration"),
        *[F.round(c(n), 6).alias(n) for n in numbers],
        F.lit(None).cast("double").alias("clinical_risk"), F.lit("NONE").alias("clinical_claim"),
        "bilateral_pair_id", "position", "left_plate_id", "right_plate_id",
        *[picture_address(exam_id, "pairs", F.col("bilateral_pair_id"), e).alias(n) for _, e, n in PAIR_PICTURES],
    )
    listed = pairs.agg(F.transform(F.array_sort(F.collect_list(F.struct("bilateral_pair_id", pair.alias("p")))), lambda s: s["p"]).alias("bilateral_analysis"))
    names = lookup.agg(F.count("*").cast("int").alias("metadata_items_supplied"))
    whole = top.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(names))  # one row each
    return whole.select(
        F.lit(exam_id).alias("exam_id"),
        F.struct(
            F.lit(exam_id).alias("exam_id"), F.lit("contact_liquid_crystal_thermography").alias("analysis_type"), F.size("sources").alias("source_images"),
            "plates_detected", "metadata_items_supplied", F.size("bilateral_analysis").alias("bilateral_pairs_created"),
            F.lit(None).cast("double").alias("clinical_risk"), F.lit("NONE").alias("clinical_claim"), F.lit("RESEARCH_REFERENCE_ANALYSIS").alias("model_status"),
            "sources", "bilateral_analysis",
        ).alias("document"),
    )


def stored_row(analyzed: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """The row that the store keeps of an analyzed examination."""
    d = lambda n: F.col(f"document.{n}")
    return analyzed.select(
        "exam_id",
        S.iso_utc(F.current_timestamp() if saved_at is None else saved_at).alias("created_at"),
        d("analysis_type").alias("analysis_type"),
        d("clinical_claim").alias("clinical_claim"),
        *[d(n).cast("long").alias(n) for n in ("source_images", "plates_detected", "bilateral_pairs_created")],
        S.strict_json(F.col("document")).alias("result_json"),
    )


def is_exam_id(text: str) -> bool:
    """Whether a text can be an examination's id: letters, digits, dots, dashes and underscores, but not dots alone."""
    return bool(text) and all(ch.isalnum() and ch.isascii() or ch in "._-" for ch in text) and not set(text) <= {"."}


def write_pictures(df: DataFrame, name: str, data: str, folder: str, ending: str = "") -> None:
    """Write a binary column as files, one for each row, from where the rows are. ``folder`` must be a mount that the executors share."""

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row[0]}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(row[1])
            os.replace(part, os.path.join(folder, row[0]))  # a task that runs again replaces whole files

    df.where(F.col(data).isNotNull()).select(file_name(F.col(name), ending), data).foreachPartition(write)


