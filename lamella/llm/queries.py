"""Queries of the training-data problems over the project's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.common import checked_broadcast, counting_label, cut, latest_rows, table
from lamella.llm import clusters, cutoffs, leakage, neighbors, percentiles, textforms, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIM = 64

#: Problem 1's scales: an area of 0.03, a ratio of e^0.08 and five units of hue count alike.
PLATE_AXES = (
    clusters.Axis("response_area_fraction", 0.03),
    clusters.Axis("largest_elongation", 0.08, "ratio"),
    clusters.Axis("hue_mean", 5.0, "circle", length=180.0),
)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def usable_plates(spark: SparkSession, d: str) -> DataFrame:
    """Latest features of plates that can be in a group."""
    c = ("plate_id", "response_area_fraction", "largest_elongation", "hue_mean", "heuristic_morphology_v0")
    latest = latest_rows(table(spark, d, "features_v0_1", *c, "ingested_at"), "plate_id", "ingested_at", *c)
    latest = latest.withColumn("label", counting_label(F.col("heuristic_morphology_v0")))
    area, ratio, hue = (F.col(x) for x in c[1:4])
    finite = ~F.isnan(ratio) & (ratio < float("inf"))
    return latest.where(F.col("label").isNotNull() & area.between(0, 1) & (ratio >= 1) & finite & (hue >= 0) & (hue < 180))


@query()
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every plate that is in a group, with the group's size and most typical plates."""
    out = clusters.cluster(usable_plates(spark, d), "plate_id", "label", PLATE_AXES)
    return out.withColumn("typical_members", F.concat_ws(",", "typical_members"))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Probe pairs whose plates are in the same group."""
    groups = clusters.members(usable_plates(spark, d), "plate_id", "label", PLATE_AXES)
    probes = table(spark, d, "plate_probe_pairs", "plate_id_a", "plate_id_b")
    return clusters.same_group_pairs(groups, probes, "plate_id", "plate_id_a", "plate_id_b")


@query()
def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other vectors of every vector."""
    return neighbors.top_similar(table(spark, d, "plate_embeddings"), "embedding_row", "embedding", DIM)


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which at least one is among the five most similar to the other."""
    return neighbors.neighbor_pairs(p2_neighbors(spark, d), "embedding_row")


SCORE = "reference_pair_anomaly_score_0_1"


def targeted_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Latest usable scores of pairs whose group has a target, computed once; and the targets."""
    c = ("bilateral_pair_id", "source_group", SCORE)
    latest = latest_rows(table(spark, d, "bilateral_reference_scores", *c, "ingested_at"), c[0], "ingested_at", *c)
    targets = table(spark, d, "keep_targets")
    named = checked_broadcast(targets.select("source_group").distinct())
    return cut(cutoffs.usable_scores(latest, "source_group", SCORE).join(named, "source_group", "left_semi")), targets


_KEPT_SQL = f"""
    WITH latest AS (
        SELECT bilateral_pair_id, source_group, {SCORE} AS s,
               row_number() OVER (PARTITION BY bilateral_pair_id ORDER BY ingested_at DESC, source_group DESC NULLS LAST, {SCORE} DESC NULLS LAST) AS pos
        FROM bilateral_reference_scores WHERE bilateral_pair_id IS NOT NULL
    ), ranked AS (
        SELECT l.*, keep_fraction AS f, count(*) OVER (PARTITION BY l.source_group) AS n,
               row_number() OVER (PARTITION BY l.source_group ORDER BY s DESC) AS place
        FROM latest l JOIN keep_targets USING (source_group)
        WHERE pos = 1 AND s BETWEEN 0 AND 1 AND NOT isnan(s)
    ), cut AS (SELECT source_group, n, max(s) AS cutoff FROM ranked WHERE place = ceil(f * n - 1e-9) GROUP BY ALL)
"""


@query(
    _KEPT_SQL
    + """
    SELECT c.source_group, c.cutoff, c.n, count(*) AS kept FROM cut c JOIN ranked r ON r.source_group = c.source_group AND r.s >= c.cutoff GROUP BY ALL
    """
)
def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff, number of usable pairs and number kept of each group with a target."""
    scores, targets = targeted_scores(spark, d)
    return cutoffs.refine_cutoffs(scores, targets, "source_group", SCORE, "keep_fraction")


@query(_KEPT_SQL + "SELECT r.source_group, r.bilateral_pair_id FROM cut c JOIN ranked r ON r.source_group = c.source_group AND r.s >= c.cutoff")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs kept."""
    scores, targets = targeted_scores(spark, d)
    limits = cutoffs.refine_cutoffs(scores, targets, "source_group", SCORE, "keep_fraction")
    return cutoffs.keep_above(scores, limits, "source_group", SCORE).select("source_group", "bilateral_pair_id")


def measured_plates(spark: SparkSession, d: str) -> DataFrame:
    """Both measures in long form: measure, label, plate_id, value, day; usable values with a counting label of latest rows."""
    parts = []
    for name, measure in (("features_v0_1", "response_area_fraction"), ("plate_reference_scores", "reference_anomaly_score_0_1")):
        c = ("plate_id", measure, "heuristic_morphology_v0", "recorded_at")
        latest = latest_rows(table(spark, d, name, *c, "ingested_at"), "plate_id", "ingested_at", *c)
        v = F.col(measure)
        parts.append(
            latest.where(v.between(0, 1) & ~F.isnan(v))
            .select(
                F.lit(measure).alias("measure"),
                counting_label(F.col("heuristic_morphology_v0")).alias("label"),
                "plate_id",
                v.alias("value"),
                F.date_format("recorded_at", "yyyy-MM-dd").alias("day"),
            )
            .where(F.col("label").isNotNull())
        )
    return parts[0].unionByName(parts[1])


@query()
def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each measure and label, from sketches of days that are combined."""
    by = ["measure", "label"]
    days = percentiles.sketch(measured_plates(spark, d), [*by, "day"], "value")
    return percentiles.percentiles(percentiles.merge_sketches(days.drop("day"), by), by, [1, 5, 25, 50, 75, 95, 99])


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Plates strictly below the 5th and strictly above the 95th percentile of their label."""
    by = ["measure", "label"]
    data = measured_plates(spark, d)
    limits = percentiles.percentiles(percentiles.sketch(data, by, "value"), by, [5, 95])
    wide = limits.groupBy(*by).agg(
        F.max(F.when(F.col("percentile") == 5, F.col("value"))).alias("low"), F.max(F.when(F.col("percentile") == 95, F.col("value"))).alias("high")
    )
    tail = F.when(F.col("value") < F.col("low"), "low").when(F.col("value") > F.col("high"), "high")
    joined = data.join(F.broadcast(wide), by)  # two measures of at most len(LABELS) labels
    return joined.select("measure", tail.alias("tail"), "plate_id").where(F.col("tail").isNotNull())


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document's text."""
    return tokens.encode_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    """
    SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_text_chars, TRUE AS same_text FROM documents
    """
)
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back from its ids; null comes back as empty."""
    texts = table(spark, d, "documents", "doc_id", "text")
    back = tokens.decode_ids(tokens.encode_texts(texts, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "back")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return texts.join(back, "doc_id").select("doc_id", F.char_length("back").cast("long").alias("n_text_chars"), same.alias("same_text"))


def leaked(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that they hold (``exact``) or only paraphrase."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")
    return leakage.leaks(docs, items, "doc_id", "item_id", "text", paraphrases=True)


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that they hold; paraphrases are found, but counted in ``p8_items`` only."""
    return leaked(spark, d).where("exact").drop("exact")


@query()
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each item."""
    return leakage.item_report(leaked(spark, d), table(spark, d, "eval_items", "item_id"), "doc_id", "item_id")


@query()
def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return textforms.with_forms(table(spark, d, "documents", "doc_id", "text"), "text").select("doc_id", "comparison", "visible")


@query()
def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of texts with the same consistent form that each document is in."""
    return textforms.forms_classes(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    return textforms.lookalike_pairs(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
