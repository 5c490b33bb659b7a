"""Queries for scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.common import table
from lamella.functions import scalars as S
from lamella.plans.registry import Registry

query = Registry()


@query(
    """
    SELECT event_id, CASE WHEN upper(trim(s)) IN ('L', 'LEFT') THEN 'LEFT' WHEN upper(trim(s)) IN ('R', 'RIGHT') THEN 'RIGHT' ELSE 'UNKNOWN' END AS side
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' left ' WHEN 'purchase' THEN 'R' ELSE event_type END AS s FROM events)
    """
)
def q10_side_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type")
    s = F.when(F.col("event_type") == "click", " left ").when(F.col("event_type") == "purchase", "R").otherwise(F.col("event_type"))
    return e.select("event_id", S.normalized_side(s).alias("side"))


@query(
    """
    SELECT c_custkey, coalesce(nullif(trim(CASE c_custkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN ' ' || c_mktsegment || ' ' ELSE c_mktsegment END), ''),
           'client-device-tlc-pending') AS profile FROM customer
    """
)
def q11_profile_default(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, "   ").when(k == 2, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).when(k == 3, F.col("c_mktsegment"))
    return c.select("c_custkey", S.profile_or_default(v).alias("profile"))


@query(
    r"""
    SELECT p_partkey, replace(substr(regexp_replace(p_name || '.v1.png', '\.[^.]+$', ''), 1, 24) || '-P' || lpad(CAST(p_size AS VARCHAR), 2, '0'), ' ', '_') AS plate_id,
           replace(replace(p_brand || '/' || p_type, '/', '_'), '\', '_') AS exam_id
    FROM part
    """
)
def q12_id_mint(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size", "p_brand", "p_type")
    file = F.concat(F.lit("dir/"), "p_name", F.lit(".v1.png"))
    return p.select("p_partkey", S.plate_name(file, F.col("p_size")).alias("plate_id"), S.path_safe(F.concat_ws("/", "p_brand", "p_type")).alias("exam_id"))


@query(
    """
    SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped
    FROM documents
    """
)
def q13_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(S.html_escape(F.col("text"))).alias("escaped"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(concat_ws(', ', CASE WHEN l_discount > 0.05 THEN 'DISCOUNT' END, CASE WHEN l_tax > 0.05 THEN 'TAX' END), ''), 'None') AS flags,
           printf('%.3f', l_quantity) AS quantity FROM lineitem
    """
)
def q14_flag_join_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", "l_quantity")
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "DISCOUNT"), F.when(F.col("l_tax") > 0.05, "TAX")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.joined_or(flags).alias("flags"), S.fixed(F.col("l_quantity")).alias("quantity"))


@query(
    """
    SELECT event_id, 'f' || CAST(event_id AS VARCHAR) AS filename, CASE WHEN event_id % 3 = 0 THEN 'LEFT' ELSE 'UNKNOWN' END AS side,
           CAST(json_extract(props, '$.k') AS INTEGER) AS k, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN '7' ELSE 'x' END AS INTEGER) AS sequence_index
    FROM events WHERE event_id % 5 <> 4
    """
)
def q15_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Upload metadata in both shapes; malformed texts and items without a name give no rows."""
    e = table(spark, d, "events", "event_id", "props")
    item = F.concat(
        F.lit('{"filename": "f'), F.col("event_id").cast("string"), F.lit('", "side": "'), F.when(F.col("event_id") % 3 == 0, " left ").otherwise("?"),
        F.lit('", "sequence_index": "'), F.when(F.col("event_id") % 2 == 0, "7").otherwise("x"), F.lit('"}'),
    )
    text = F.when(F.col("event_id") % 5 == 4, "not json").when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(
        F.concat(F.lit('{"files": ['), item, F.lit(', {"side": "L"}]}'))
    )
    items = e.select("event_id", "props", F.explode(S.upload_items(text)).alias("item")).where("item.filename is not null")
    return items.select(
        "event_id",
        "item.filename",
        S.normalized_side(F.col("item.side")).alias("side"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.col("item.sequence_index").try_cast("int").alias("sequence_index"),
    )


@query(
    """
    WITH j AS (SELECT plate_id, ingested_at, recorded_at, CASE WHEN isfinite(reference_anomaly_score_0_1) THEN reference_anomaly_score_0_1 END AS score,
                      CASE WHEN json_valid(nearest_neighbors_json) THEN CAST(nearest_neighbors_json AS JSON) END AS j FROM plate_reference_scores)
    SELECT plate_id, ingested_at, recorded_at, score, count(*) AS n_rows, CAST(max(json_array_length(j)) AS INTEGER) AS n_neighbors,
           max(json_extract_string(j, '$[0].plate_id')) AS first_neighbor, max(TRY_CAST(json_extract_string(j, '$[0].cosine_distance') AS DOUBLE)) AS first_distance
    FROM j WHERE json_type(j) = 'ARRAY' GROUP BY ALL
    """
)
def q16_json_array(spark: SparkSession, d: str) -> DataFrame:
    """Stored neighbour lists that can be read: how many neighbours, and the first one."""
    t = table(spark, d, "plate_reference_scores", "plate_id", "ingested_at", "recorded_at", "reference_anomaly_score_0_1", "nearest_neighbors_json")
    near = S.neighbor_list(F.col("nearest_neighbors_json"))
    t = t.select("plate_id", "ingested_at", "recorded_at", S.finite_or_null(F.col("reference_anomaly_score_0_1")).alias("score"), near.alias("near"))
    first = F.get("near", F.lit(0))
    return t.where("near is not null").groupBy("plate_id", "ingested_at", "recorded_at", "score").agg(
        F.count("*").alias("n_rows"),
        F.max(F.size("near")).alias("n_neighbors"),
        F.max(first["plate_id"]).alias("first_neighbor"),
        F.max(first["cosine_distance"]).alias("first_distance"),
    )


@query("SELECT o_orderkey, round(o_totalprice, 2) AS total, o_orderpriority AS priority, CAST(NULL AS DOUBLE) AS risk FROM orders")
def q17_strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as strict JSON and back; numbers that are not finite would raise."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    row = F.struct(F.round("o_totalprice", 2).alias("total"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("double").alias("risk"))
    text = S.strict_json(row, F.col("o_totalprice"))
    return o.select("o_orderkey", F.from_json(text, "total double, priority string, risk double").alias("j")).select("o_orderkey", "j.*")


@query(
    """
    SELECT plate_id, ingested_at, count(*) AS n, max(CASE WHEN isfinite(v) THEN v END) AS clean, max(CASE WHEN NOT isnan(v) THEN v END) AS nan_only,
           max(CASE WHEN isfinite(v) THEN v ELSE 0.0 END) AS zero
    FROM (SELECT plate_id, ingested_at, response_area_fraction AS v FROM features_v0_1) GROUP BY ALL
    """
)
def q18_null_clean(spark: SparkSession, d: str) -> DataFrame:
    """Three ways to clean numbers: not finite as null, NaN as null, not finite as zero."""
    v = F.col("response_area_fraction")
    rows = table(spark, d, "features_v0_1", "plate_id", "ingested_at", "response_area_fraction")
    rows = rows.withColumns({"a": S.finite_or_null(v), "b": S.nan_to_null(v), "c": S.number_or_zero(v)})
    return rows.groupBy("plate_id", "ingested_at").agg(F.count("*").alias("n"), F.max("a").alias("clean"), F.max("b").alias("nan_only"), F.max("c").alias("zero"))


@query(
    """
    SELECT p_partkey, round(p_retailprice / 7, 6) AS rounded, CAST(trunc(p_retailprice) AS INTEGER) AS truncated, CAST(round_even(p_size * 1.5, 0) AS INTEGER) AS half_even, p_size // 4 AS quarter
    FROM part
    """
)
def q19_round_typed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    return p.select(
        "p_partkey",
        F.round(F.col("p_retailprice") / 7, 6).alias("rounded"),
        S.truncated(F.col("p_retailprice")).alias("truncated"),
        S.half_even(F.col("p_size") * 1.5).alias("half_even"),
        F.expr("p_size div 4").cast("int").alias("quarter"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, least(abs(a - b), 180 - abs(a - b)) AS hue_distance
    FROM (SELECT *, CAST(l_quantity * 17 AS INTEGER) % 180 AS a, CAST(l_partkey % 180 AS INTEGER) AS b FROM lineitem)
    """
)
def q20_hue_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a, b = (F.col("l_quantity") * 17).cast("int") % 180, (F.col("l_partkey") % 180).cast("int")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.hue_distance(a, b, 180).cast("int").alias("hue_distance"))


@query(
    """
    WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, CAST(coalesce(max(CASE WHEN event_type = 'click' THEN n END), 0) AS BIGINT) AS clicks,
           CAST(coalesce(max(CASE WHEN event_type = 'no such type' THEN n END), -1) AS BIGINT) AS absent, CAST(count(*) AS INTEGER) AS n_types FROM n GROUP BY user_id
    """
)
def q24_map_default(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type as a map, looked up with defaults."""
    n = table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select(
        "user_id",
        F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"),
        F.coalesce(F.try_element_at("m", F.lit("no such type")), F.lit(-1)).cast("long").alias("absent"),
        F.size(F.map_keys("m")).alias("n_types"),
    )


@query(
    """
    WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, list(o_orderpriority ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY ALL)
    SELECT o_custkey, CAST(i AS INTEGER) AS ordinal, keys[i] AS o_orderkey, open[i] AS priority
    FROM (SELECT *, unnest(range(1, least(len(keys), coalesce(len(open), 0)) + 1)) AS i FROM o)
    """
)
def q25_array_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two arrays zipped to the shorter one's length, numbered from 1."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    lists = o.groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")))).alias("open")
    )
    zipped = lists.select("o_custkey", F.posexplode(S.zip_short(F.col("keys"), F.col("open"))).alias("i", "z"))
    return zipped.select("o_custkey", (F.col("i") + 1).alias("ordinal"), F.col("z.a").alias("o_orderkey"), F.col("z.b").alias("priority"))


@query("SELECT p_partkey AS part_id, p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AS listed, greatest(1, least(p_size, 20)) AS size_clamped FROM part")
def q26_membership_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size").withColumnRenamed("p_partkey", "part_id")
    clamped = F.greatest(F.lit(1), F.least("p_size", F.lit(20)))
    return p.withColumns({"listed": F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23"), "size_clamped": clamped}).drop("p_brand", "p_size")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at FROM events")
def q27_iso_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts").select("event_id", S.iso_utc(F.col("ts")).alias("created_at"))


@query("SELECT p_partkey, url_encode(p_name || ' & ' || p_brand) AS address FROM part")
def q28_url_encode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", S.url_component(F.concat("p_name", F.lit(" & "), "p_brand")).alias("address"))
