"""Queries for aggregates, the store and the model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.common import cut, ensure_checkpoint_dir, latest_rows, remove_folder, table
from lamella.functions import scalars as S
from lamella.model import reference as M
from lamella.operators import quantiles, stats, store, vectors
from lamella.plans.registry import Registry
from lamella.raster.plates import FEATURES
from lamella.sources import ledgers

query = Registry()


@query(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total_quantity, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS discounted,
           round(count(*) FILTER (WHERE l_tax > 0.04) / greatest(CAST(count(*) FILTER (WHERE l_tax > 10) AS DOUBLE), 1.0), 6) AS guarded FROM lineitem GROUP BY ALL
    """
)
def q40_fractions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("total_quantity"),
        F.round(stats.share_of(F.col("l_discount") > 0.05), 6).alias("discounted"),
        F.round(S.safe_ratio(F.count_if(F.col("l_tax") > 0.04), F.count_if(F.col("l_tax") > 10)), 6).alias("guarded"),
    )


@query(
    """
    SELECT l_returnflag, round(coalesce(avg(l_extendedprice) FILTER (WHERE l_quantity > 25), 0), 4) AS mean_price, round(coalesce(stddev_pop(l_extendedprice) FILTER (WHERE l_quantity > 25), 0), 4) AS std_price,
           coalesce(avg(l_tax) FILTER (WHERE l_quantity > 1000), 0.0) AS empty_mean FROM lineitem GROUP BY ALL
    """
)
def q41_masked_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    mask = F.col("l_quantity") > 25
    return rows.groupBy("l_returnflag").agg(
        F.round(stats.mean_or_zero(F.col("l_extendedprice"), mask), 4).alias("mean_price"),
        F.round(stats.std_or_zero(F.col("l_extendedprice"), mask), 4).alias("std_price"),
        stats.mean_or_zero(F.col("l_tax"), F.col("l_quantity") > 1000).alias("empty_mean"),
    )


@query(
    """
    SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05), 4) AS p95_p5, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
    FROM lineitem GROUP BY ALL
    """
)
def q42_percentile_range(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of groups of any size."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    p = quantiles.exact_percentiles(rows, ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), [0.05, 0.9, 0.95], "p")
    return p.select("l_returnflag", "l_linestatus", F.round(F.col("p")[2] - F.col("p")[0], 4).alias("p95_p5"), F.round(F.col("p")[1], 4).alias("p90"))


@query(
    """
    SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1
    """
)
def q43_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    best = stats.first_largest(F.struct("l_partkey", "l_extendedprice"), F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))
    return rows.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.*")


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS events FROM events GROUP BY ALL")
def q44_multimap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_id")
    return e.groupBy("user_id").agg(F.concat_ws(",", stats.sorted_list(F.col("event_id")).cast("array<string>")).alias("events"))


@query(
    """
    WITH s AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 9) AS v FROM embeddings)
    SELECT a.vec_id, round(avg(CAST(b.v <= a.v AS DOUBLE)), 6) AS percentile FROM s a, (SELECT v FROM s WHERE label = 0) b GROUP BY a.vec_id
    """
)
def q45_ecdf(spark: SparkSession, d: str) -> DataFrame:
    """Share of a reference set at or below each value."""
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 9).alias("v"))
    out = M.empirical_percentile(e, F.col("v"), e.where("label = 0"), F.col("v"), "p")
    return out.select("vec_id", F.round("p", 6).alias("percentile"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def q46_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "user_id").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q50_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The row of each key that was saved last, all columns."""
    e = table(spark, d, "events")
    best = F.max_by(F.struct(*e.columns), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(best.alias("b")).select("b.*")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def q51_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.detail(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 42)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = -1")
def q55_missing_key(spark: SparkSession, d: str) -> DataFrame:
    """A key that is not there has no row."""
    return store.detail(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", -1)


_PLATE_SQL = """'<section class=''plate''><h3>&lt;' || l_partkey || '&gt;</h3><p>Morphology: ' || l_returnflag || ' &amp; ' || l_linestatus || '</p><p>Reference percentile: '
    || printf('%.3f', l_discount) || '</p><p>Quality: REVIEW (' || CASE WHEN l_tax > 0.05 THEN 'LOW &lt;TAX&gt;, ' ELSE '' END || 'FLAG' || ')</p></section>'"""


@query(
    f"""
    WITH p AS (SELECT l_orderkey, string_agg({_PLATE_SQL}, '' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, l_discount, l_tax) AS plates,
                      string_agg(CASE WHEN l_quantity > 45 THEN '<section class=''pair''><h3>E' || l_orderkey || '-BP-' || l_linenumber || '</h3><p>' || l_partkey || ' / ' || l_suppkey
                                 || '</p><p>Asymmetry: ' || printf('%.3f', l_tax) || '</p></section>' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax) AS pairs FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, md5('<!doctype html><html><head><meta charset=''utf-8''><title>Report E' || l_orderkey || '</title></head><body><h1>E' || l_orderkey
           || '</h1><p>Unusualness relative to reference data. Not a diagnosis.</p>' || plates || coalesce(pairs, '<p>No bilateral pairs.</p>') || '</body></html>') AS page FROM p
    """
)
def q56_report_html(spark: SparkSession, d: str) -> DataFrame:
    """Whole reports of examinations: an order stands for one, its lines for plates and some of them for pairs."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    text = lambda c: F.col(c).cast("string")
    flags = F.array_compact(F.array(F.when(F.col("l_tax") > 0.05, "LOW <TAX>"), F.lit("FLAG")))
    plate = F.struct(
        F.concat(F.lit("<"), text("l_partkey"), F.lit(">")).alias("plate_id"),
        F.struct(F.lit("REVIEW").alias("status"), flags.alias("flags")).alias("qc"),
        F.concat_ws(" & ", "l_returnflag", "l_linestatus").alias("morphology_descriptor"),
        F.col("l_discount").alias("reference_anomaly_percentile"),
    )
    pair = F.struct(
        F.concat(F.lit("E"), text("l_orderkey"), F.lit("-BP-"), text("l_linenumber")).alias("bilateral_pair_id"),
        text("l_partkey").alias("left_plate_id"), text("l_suppkey").alias("right_plate_id"), F.col("l_tax").alias("reference_asymmetry_score_0_1"),
    )

    def in_order(keys: tuple[str, ...], value, where=None):
        own = F.struct(*keys, value.alias("p"))
        return F.transform(F.array_sort(F.collect_list(own if where is None else F.when(where, own))), lambda s: s["p"])

    document = rows.groupBy("l_orderkey").agg(
        in_order(("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax"), plate).alias("plates"),
        in_order(("l_linenumber", "l_partkey", "l_suppkey", "l_tax"), pair, F.col("l_quantity") > 45).alias("pairs"),
    )
    exam = F.concat(F.lit("E"), text("l_orderkey")).alias("exam_id")
    document = document.select("l_orderkey", F.struct(exam, F.array(F.struct("plates")).alias("sources"), F.col("pairs").alias("bilateral_analysis")).alias("d"))
    return document.select("l_orderkey", F.md5(store.report_html(F.col("d"))).alias("page"))


@query(
    """
    SELECT o_orderkey, '<li>' || replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;') || ': ' || printf('%.3f', round(o_totalprice, 2)) || '</li>' AS fragment FROM orders
    """
)
def q52_report_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    text = F.concat(F.lit("<li>"), S.html_escape(F.col("o_orderpriority")), F.lit(": "), S.fixed(F.round("o_totalprice", 2)), F.lit("</li>"))
    return o.select("o_orderkey", text.alias("fragment"))


@query(
    """
    SELECT plate_id, CASE WHEN isfinite(reference_anomaly_score_0_1) THEN reference_anomaly_score_0_1 END AS score, nearest_neighbors_json AS neighbors FROM
    (SELECT * FROM plate_reference_scores WHERE plate_id IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY ingested_at DESC, reference_anomaly_score_0_1 DESC NULLS LAST, nearest_neighbors_json DESC NULLS LAST) = 1)
    """
)
def q53_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as a CSV ledger and read again; cells hold JSON with quotes, line ends and empty texts. Numbers that are not finite are none."""
    c = ("plate_id", "reference_anomaly_score_0_1", "nearest_neighbors_json")
    rows = latest_rows(table(spark, d, "plate_reference_scores", *c, "ingested_at"), "plate_id", "ingested_at", *c)
    path = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    renamed = rows.select("plate_id", S.finite_or_null(F.col(c[1])).alias("score"), F.col(c[2]).alias("neighbors"))
    ledgers.write_ledger(renamed, path, null="\\N")
    out = cut(ledgers.read_ledger(spark, path, ledgers.schema("plate_id:s score:d neighbors:s"), null="\\N"))
    remove_folder(spark, path)
    return out


@query(
    """
    SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice, 2) AS price, 'NONE' AS claim FROM lineitem
    """
)
def q54_document_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Lines nested in their order's document, as strict JSON, and flat again."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    line = F.struct("l_partkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))
    docs = rows.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines")).withColumn("claim", F.lit("NONE"))
    text = docs.select("l_orderkey", S.strict_json(F.struct("claim", "lines")).alias("j"))
    back = text.select("l_orderkey", F.from_json("j", "claim string, lines array<struct<l_partkey:bigint,l_linenumber:int,price:double>>").alias("j"))
    return back.select("l_orderkey", "j.claim", F.explode("j.lines").alias("line")).select("l_orderkey", "line.*", "claim")


@query(
    """
    WITH p AS (SELECT quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS s FROM part)
    SELECT p_partkey, round((p_retailprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scaled FROM part, p
    """
)
def q60_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    scaled = M.robust_scaled(table(spark, d, "part", "p_partkey", "p_retailprice"), ["p_retailprice"])
    return scaled.select("p_partkey", F.round("p_retailprice", 6).alias("scaled"))


@query(
    """
    SELECT vec_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-12), 6) AS score FROM (SELECT vec_id, embedding[1]::DOUBLE AS v FROM embeddings)
    """
)
def q61_minmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding")[0].cast("double").alias("v"))
    return vectors.min_max(e, F.col("v"), "s").select("vec_id", F.round("s", 6).alias("score"))


def _reference_model(spark: SparkSession, d: str) -> tuple[M.ReferenceModel, DataFrame, list[str]]:
    """A model of the vectors with label 0, and all vectors with a column for each component used."""
    columns = [f"e{i}" for i in range(64)]
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    wide = e.select(F.col("vec_id").cast("string").alias("plate_id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return M.ReferenceModel.fit(wide.where("label = 0"), "plate_id", columns), wide, columns


@query()
def q64_feature_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Every plate's percentile of unusualness by its 18 features, and its nearest plates.

    The reference are the latest features of all plates, of more than the model's bound those with the smallest hashes; all plates are scored.
    """
    rows = table(spark, d, "features_v0_1", "plate_id", "ingested_at", *FEATURES)
    latest = latest_rows(rows, "plate_id", "ingested_at", "plate_id", *FEATURES)
    out = M.ReferenceModel.fit(latest, "plate_id", list(FEATURES), bound=2_000).transform(latest)
    return out.select("plate_id", "reference_anomaly_percentile", F.concat_ws(",", "nearest_reference_plates.plate_id").alias("nearest"))


@query()
def q62_pca_scores(spark: SparkSession, d: str) -> DataFrame:
    """Share of the variance that each principal component of the reference explains."""
    model, _, _ = _reference_model(spark, d)
    rows = [(i + 1, round(float(v), 6)) for i, v in enumerate(model.explained)]
    return spark.createDataFrame(rows, "component int, explained double")


@query()
def q63_iforest_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's percentile of unusualness among the reference, and its nearest reference vectors."""
    model, wide, columns = _reference_model(spark, d)
    out = model.transform(wide)
    return out.select("plate_id", "reference_anomaly_percentile", F.concat_ws(",", "nearest_reference_plates.plate_id").alias("nearest"))
