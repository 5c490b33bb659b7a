"""Queries for ledgers: joins, pairing, top-k, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.common import latest_rows, table
from lamella.functions import scalars as S
from lamella.operators import ledger, pairing, store, vectors
from lamella.plans.registry import Registry

query = Registry()


def latest_sql(name: str, key: str, columns: str) -> str:
    """The latest rows of a table; rows that tie are told apart by ``columns``, the greatest first."""
    order = ", ".join(f"{c.strip()} DESC NULLS LAST" for c in f"ingested_at, {columns}".split(","))
    return f"(SELECT {key}, {columns} FROM {name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


def _clean_sql(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


_SCORES = "reference_anomaly_score_0_1, status, heuristic_morphology_v0"
_FEATURES = "response_area_fraction, component_count, largest_elongation, hue_mean"


def _names(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(",")]


@query(
    f"""
    SELECT s.plate_id, {_clean_sql("s.reference_anomaly_score_0_1")} AS reference_anomaly_score_0_1, s.status, s.heuristic_morphology_v0,
           {_clean_sql("f.response_area_fraction")} AS response_area_fraction, f.component_count, {_clean_sql("f.largest_elongation")} AS largest_elongation,
           {_clean_sql("f.hue_mean")} AS hue_mean, {_clean_sql("i.dinov2_reference_anomaly_score_0_1")} AS dinov2_reference_anomaly_score_0_1,
           '/static/plates/' || s.plate_id || '.png' AS image_url, 'REFERENCE_UNUSUALNESS_ONLY' AS score_semantics
    FROM {latest_sql("plate_reference_scores", "plate_id", _SCORES)} s
    LEFT JOIN {latest_sql("features_v0_1", "plate_id", _FEATURES)} f ON f.plate_id = s.plate_id
    LEFT JOIN {latest_sql("plate_index", "plate_id", "dinov2_reference_anomaly_score_0_1")} i ON i.plate_id = s.plate_id
    """
)
def q01_reference_plates(spark: SparkSession, d: str) -> DataFrame:
    """Scored plates with their features and embedding score joined on."""
    parts = []
    for name, columns in (("plate_reference_scores", _SCORES), ("features_v0_1", _FEATURES), ("plate_index", "dinov2_reference_anomaly_score_0_1")):
        c = _names(columns)
        parts.append(latest_rows(table(spark, d, name, "plate_id", "ingested_at", *c), "plate_id", "ingested_at", "plate_id", *c))
    return ledger.reference_plates(*parts)


_FUSED = "embedding_norm, status"


@query(
    f"""
    SELECT s.plate_id, {_clean_sql("s.reference_anomaly_score_0_1")} AS reference_anomaly_score_0_1, s.status, s.heuristic_morphology_v0,
           {_clean_sql("f.response_area_fraction")} AS response_area_fraction, f.component_count, {_clean_sql("f.largest_elongation")} AS largest_elongation,
           {_clean_sql("f.hue_mean")} AS hue_mean, {_clean_sql("i.dinov2_reference_anomaly_score_0_1")} AS dinov2_reference_anomaly_score_0_1,
           {_clean_sql("u.embedding_norm")} AS fused_score, '/static/plates/' || s.plate_id || '.png' AS image_url, 'REFERENCE_UNUSUALNESS_ONLY' AS score_semantics
    FROM {latest_sql("plate_reference_scores", "plate_id", _SCORES)} s
    LEFT JOIN {latest_sql("features_v0_1", "plate_id", _FEATURES)} f ON f.plate_id = s.plate_id
    LEFT JOIN {latest_sql("plate_index", "plate_id", "dinov2_reference_anomaly_score_0_1")} i ON i.plate_id = s.plate_id
    LEFT JOIN (SELECT * FROM {latest_sql("plate_reference_scores", "plate_id", _FUSED)} WHERE embedding_norm > 1) u ON u.plate_id = s.plate_id
    """
)
def q33_fused_plates(spark: SparkSession, d: str) -> DataFrame:
    """As q01, with a ledger of fused scores joined last; here some plates' lengths stand for fused scores."""
    parts = []
    for name, columns in (("plate_reference_scores", _SCORES), ("features_v0_1", _FEATURES), ("plate_index", "dinov2_reference_anomaly_score_0_1"), ("plate_reference_scores", _FUSED)):
        c = _names(columns)
        parts.append(latest_rows(table(spark, d, name, "plate_id", "ingested_at", *c), "plate_id", "ingested_at", "plate_id", *c))
    fused = parts.pop().where("embedding_norm > 1 and not isnan(embedding_norm)").withColumnRenamed("embedding_norm", "fused_score")
    return ledger.reference_plates(*parts, fused=fused)


@query(
    """
    WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 4 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'AUTO-' || lpad(CAST(i AS VARCHAR), 2, '0') WHEN 1 THEN '' ELSE 'P' || k END AS position,
           CAST(CASE k WHEN 0 THEN i WHEN 1 THEN 0 ELSE k END AS INTEGER) AS sequence_index FROM n
    """
)
def q34_position_default(spark: SparkSession, d: str) -> DataFrame:
    """Positions and sequence numbers with their defaults; an empty position and an explicit 0 stay."""
    k = F.col("event_id") % 4
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events", "event_id", "user_id").withColumn("i", ordinal)
    position = F.when(k == 1, "").when(k > 1, F.concat(F.lit("P"), k.cast("string")))
    sequence = F.when(k == 1, 0).when(k > 1, k.cast("int"))
    return e.select("event_id", S.position_or_auto(position, F.col("i")).alias("position"), F.coalesce(sequence, "i").alias("sequence_index"))


_PAIR = "source_group, left_reference_plate, right_reference_plate, absolute_area_fraction_delta, reference_pair_anomaly_score_0_1"


@query(
    f"""
    SELECT bilateral_pair_id, source_group, left_reference_plate, right_reference_plate, {_clean_sql("absolute_area_fraction_delta")} AS absolute_area_fraction_delta,
           {_clean_sql("reference_pair_anomaly_score_0_1")} AS reference_pair_anomaly_score_0_1, '/static/bilateral/' || bilateral_pair_id || '.png' AS panel_url,
           'REFERENCE_UNUSUALNESS_ONLY' AS score_semantics, CAST(NULL AS DOUBLE) AS clinical_risk, 'NONE' AS clinical_claim
    FROM {latest_sql("bilateral_reference_scores", "bilateral_pair_id", _PAIR)}
    """
)
def q02_pair_records(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs with cleaned numbers, an address and the guardrails."""
    c = _names(_PAIR)
    rows = table(spark, d, "bilateral_reference_scores", "bilateral_pair_id", "ingested_at", *c)
    return ledger.pair_records(latest_rows(rows, "bilateral_pair_id", "ingested_at", "bilateral_pair_id", *c))


@query(
    """
    WITH last AS (SELECT exam_id AS k, coalesce(source, 'none') AS source, n_chars FROM documents WHERE exam_id IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY exam_id ORDER BY written_at DESC NULLS LAST, doc_id DESC) = 1)
    SELECT e.exam_id, coalesce(l.source, 'none') AS source, coalesce(l.n_chars, 0) AS n_chars
    FROM (SELECT DISTINCT exam_id FROM exams WHERE exam_id IS NOT NULL) e LEFT JOIN last l ON l.k = e.exam_id
    """
)
def q03_lookup_join_default(spark: SparkSession, d: str) -> DataFrame:
    """Exams with the last document about each, or defaults."""
    docs = table(spark, d, "documents", "doc_id", "exam_id", "source", "n_chars", "written_at").where("exam_id is not null")
    lookup = pairing.last_wins(docs, ["exam_id"], [F.coalesce("written_at", F.lit("0001-01-01").cast("timestamp_ntz")), "doc_id"])
    exams = table(spark, d, "exams", "exam_id").where("exam_id is not null").distinct()
    return pairing.lookup_with_default(exams, lookup, "exam_id", {"source": "none", "n_chars": 0})


@query(
    """
    SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'
    """
)
def q04_position_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Positions that have both sides: one aggregation instead of a join."""
    e = table(spark, d, "events", "user_id", "event_type").where(F.col("event_type").isin("click", "purchase"))
    sides = e.groupBy("user_id").agg(F.max(F.col("event_type") == "click").alias("l"), F.max(F.col("event_type") == "purchase").alias("r"))
    return sides.where(F.col("l") & F.col("r")).select("user_id")


@query(
    """
    WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ordinal
               FROM events WHERE event_type IN ('click', 'purchase')),
    p AS (SELECT l.user_id, CAST(l.ordinal AS INTEGER) AS ordinal, l.event_id AS left_event_id, r.event_id AS right_event_id
          FROM n l JOIN n r ON l.user_id = r.user_id AND l.ordinal = r.ordinal AND l.event_type = 'click' AND r.event_type = 'purchase')
    SELECT *, 'U' || CAST(user_id AS VARCHAR) || '-BP-' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ordinal) AS VARCHAR), 3, '0') AS bilateral_pair_id FROM p
    """
)
def q05_zip_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The n-th left with the n-th right event of a position."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    pairs = pairing.zip_pairs(e, ["user_id"], "event_type", "click", "purchase", ["ts", "event_id"], ["event_id"])
    return pairing.pair_names(pairs, F.concat(F.lit("U"), F.col("user_id").cast("string")), ["user_id"], ["ordinal"])


def _circles(spark: SparkSession, d: str) -> DataFrame:
    """Circles made from parts: a brand is an image."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    x = (F.col("p_partkey") * 37 % 400).cast("double")
    y = (F.col("p_partkey") * 91 % 400).cast("double")
    return p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), x.alias("x"), y.alias("y"), (F.col("p_size") + 5.0).alias("r"), F.col("p_retailprice").alias("score"))


_CIRCLES = """c AS (SELECT p_brand AS brand, p_partkey AS id, CAST(p_partkey * 37 % 400 AS DOUBLE) AS x, CAST(p_partkey * 91 % 400 AS DOUBLE) AS y,
              p_size + 5.0::DOUBLE AS r, p_retailprice AS score FROM part)"""


def _iou_sql(a: str, b: str) -> str:
    d = f"sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2)"
    lens = f"""({a}.r * {a}.r * acos(greatest(-1, least(1, ({d} ** 2 + {a}.r ** 2 - {b}.r ** 2) / greatest(2 * {d} * {a}.r, 1e-300))))
        + {b}.r * {b}.r * acos(greatest(-1, least(1, ({d} ** 2 + {b}.r ** 2 - {a}.r ** 2) / greatest(2 * {d} * {b}.r, 1e-300))))
        - sqrt(greatest(0, ({a}.r + {b}.r - {d}) * ({d} + {a}.r - {b}.r) * ({d} - {a}.r + {b}.r) * ({d} + {a}.r + {b}.r))) / 2)"""
    shared = f"CASE WHEN {d} <= greatest({a}.r, {b}.r) - least({a}.r, {b}.r) THEN pi() * least({a}.r, {b}.r) ** 2 ELSE {lens} END"
    return f"CASE WHEN {d} >= {a}.r + {b}.r THEN 0 ELSE ({shared}) / greatest(pi() * ({a}.r ** 2 + {b}.r ** 2) - ({shared}), 1e-9) END"


@query(
    f"""
    WITH {_CIRCLES}, j AS (SELECT a.id AS id_a, b.id AS id_b, {_iou_sql("a", "b")} AS iou FROM c a JOIN c b ON a.brand = b.brand AND a.id < b.id)
    SELECT id_a, id_b, round(iou, 6) AS iou FROM j WHERE round(iou, 6) > 0
    """
)
def q06_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping circles of an image."""
    return pairing.overlapping_circles(_circles(spark, d), "brand", digits=6).select("id_a", "id_b", "iou")


@query(
    f"""
    WITH RECURSIVE {_CIRCLES}, n AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, id) AS k FROM c),
    w AS (
        SELECT brand, k, [struct_pack(id := id, x := x, y := y, r := r)] AS kept FROM n WHERE k = 1
        UNION ALL
        SELECT n.brand, n.k, CASE WHEN len(list_filter(w.kept, lambda o: {_iou_sql("o", "n")} >= 0.35)) > 0 THEN w.kept
                             ELSE list_append(w.kept, struct_pack(id := n.id, x := n.x, y := n.y, r := n.r)) END
        FROM w JOIN n ON n.brand = w.brand AND n.k = w.k + 1
    )
    SELECT brand, unnest(kept).id AS id FROM w QUALIFY k = max(k) OVER (PARTITION BY brand)
    """
)
def q07_nms_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Circles that survive greedy suppression of overlaps."""
    return pairing.greedy_circles(_circles(spark, d), ["brand"]).select("brand", "id")


@query(
    """
    WITH q AS (SELECT vec_id, embedding FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS neighbor,
                 round(greatest(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.0), 9) AS cosine_distance
          FROM q a JOIN q b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine_distance, neighbor) AS INTEGER) AS rank, neighbor, round(cosine_distance, 6) AS cosine_distance
    FROM p QUALIFY rank <= 5
    """
)
def q08_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest reference vectors of every vector, exact."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    near = vectors.nearest_reference(e, e, "vec_id", "embedding")
    return near.withColumn("cosine_distance", F.round("cosine_distance", 6))


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def q30_history_topn(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of the history, a top-k report."""
    o = table(spark, d, "orders")
    return store.history(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"], 50)


@query(
    """
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem)
    SELECT o.o_orderkey, CAST(ordinal AS INTEGER) AS ordinal, l_partkey, l_linenumber FROM orders o JOIN l ON l.l_orderkey = o.o_orderkey
    """
)
def q32_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Lines nested in their order, then flattened with their number."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("lines"))
    orders = table(spark, d, "orders", "o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    flat = orders.select("o_orderkey", F.posexplode("lines").alias("i", "line"))
    return flat.select("o_orderkey", (F.col("i") + 1).alias("ordinal"), "line.l_partkey", "line.l_linenumber")
