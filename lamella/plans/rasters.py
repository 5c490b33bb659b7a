"""Queries for raster operators: each vector of ``embeddings`` is a grid of 8 x 8 levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.common import table
from lamella.functions import scalars as S
from lamella.plans.registry import Registry
from lamella.raster import filters, grids, plates, shapes

query = Registry()

LEVEL = 140
_G = """g AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor((e::DOUBLE + 0.6) / 1.2 * 255) AS INTEGER) AS p
        FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
_DISK = "((x - 4) * (x - 4) + (y - 4) * (y - 4) <= 3.68 * 3.68)"


def _grids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", grids.levels(F.col("embedding")).alias("p"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Grids 2k and 2k + 1 beside each other."""
    g = _grids(spark, d).withColumn("pair", F.floor(F.col("vec_id") / 2).cast("long"))
    even = F.col("vec_id") % 2 == 0
    both = g.groupBy("pair").agg(F.max(F.when(even, F.col("p"))).alias("l"), F.max(F.when(~even, F.col("p"))).alias("r"))
    return both.where("l is not null and r is not null")


_PAIRS = f"""{_G}, pp AS (SELECT a.vec_id // 2 AS pair, a.y, a.x, a.p AS l, b.p AS r, a.p > {LEVEL} AS ml, b.p > {LEVEL} AS mr
              FROM g a JOIN g b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 AND a.y = b.y AND a.x = b.x)"""
_PAIR_COUNTS = """SELECT pair, count(*) FILTER (WHERE ml AND mr) AS n_both, count(*) FILTER (WHERE ml OR mr) AS n_either, count(*) FILTER (WHERE ml <> mr) AS n_one,
        count(*) FILTER (WHERE ml) AS n_left, count(*) FILTER (WHERE mr) AS n_right,
        CAST(coalesce(sum(least(abs(l - r) % 180, 180 - abs(l - r) % 180)) FILTER (WHERE ml AND mr), 0) AS BIGINT) AS hue_sum FROM pp GROUP BY pair"""


def _pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Common, united and different pixels of pairs, from array expressions alone."""
    z = F.arrays_zip("l", "r")
    set_l, set_r = (lambda c: c["l"] > LEVEL), (lambda c: c["r"] > LEVEL)

    def hue(c):
        return S.hue_distance(F.abs(c["l"] - c["r"]) % 180, F.lit(0), 180)

    def count(f):
        return F.size(F.filter(z, f)).cast("long")

    common = F.filter(z, lambda c: set_l(c) & set_r(c))
    return _pairs(spark, d).select(
        "pair",
        count(lambda c: set_l(c) & set_r(c)).alias("n_both"),
        count(lambda c: set_l(c) | set_r(c)).alias("n_either"),
        count(lambda c: set_l(c) != set_r(c)).alias("n_one"),
        count(set_l).alias("n_left"),
        count(set_r).alias("n_right"),
        F.aggregate(common, F.lit(0).cast("long"), lambda s, c: s + hue(c).cast("long")).alias("hue_sum"),
    )


@query(f"WITH {_PAIRS} SELECT pair, n_both, n_either, n_one, round(n_both / greatest(n_either, 1), 6) AS jaccard FROM ({_PAIR_COUNTS})")
def q09_pixel_pair(spark: SparkSession, d: str) -> DataFrame:
    c = _pair_counts(spark, d)
    return c.select("pair", "n_both", "n_either", "n_one", F.round(S.safe_ratio(F.col("n_both"), F.col("n_either")), 6).alias("jaccard"))


_SCORE = """round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE * xor_share + 0.25::DOUBLE * abs(area) + 0.2::DOUBLE * (1 - jaccard) + 0.1::DOUBLE * coalesce(hue, 0) / 90)), 6)"""
_PAIR_SHARES = f"""SELECT *, n_one / 64.0::DOUBLE AS xor_share, n_left / 64.0::DOUBLE - n_right / 64.0::DOUBLE AS area, n_both / greatest(n_either, 1)::DOUBLE AS jaccard,
        CASE WHEN n_both > 0 THEN hue_sum / n_both::DOUBLE END AS hue FROM ({_PAIR_COUNTS})"""


def _pair_scores(spark: SparkSession, d: str) -> DataFrame:
    c = _pair_counts(spark, d).withColumns(
        {
            "xor_share": F.col("n_one") / 64.0,
            "area": F.col("n_left") / 64.0 - F.col("n_right") / 64.0,
            "jaccard": S.safe_ratio(F.col("n_both"), F.col("n_either")),
            "hue": F.when(F.col("n_both") > 0, F.col("hue_sum").cast("double") / F.greatest("n_both", F.lit(1))),
        }
    )
    return c.withColumn("score", F.round(S.asymmetry_score(F.col("xor_share"), F.col("area"), F.col("jaccard"), F.col("hue")), 6))


@query(f"WITH {_PAIRS} SELECT pair, {_SCORE} AS score FROM ({_PAIR_SHARES})")
def q21_asymmetry_score(spark: SparkSession, d: str) -> DataFrame:
    return _pair_scores(spark, d).select("pair", "score")


@query(
    f"""
    WITH {_PAIRS}, m AS (SELECT pair, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.65::DOUBLE * (CASE WHEN ml AND mr THEN least(abs(l - r) % 180, 180 - abs(l - r) % 180) / 90.0::DOUBLE ELSE 0.0::DOUBLE END)
                        + 0.35::DOUBLE * CAST(ml <> mr AS INTEGER)::DOUBLE)) AS v FROM pp)
    SELECT pair, CAST(sum(CAST(floor(v * 255) AS INTEGER)) AS BIGINT) AS level_sum, CAST(max(CAST(floor(v * 255) AS INTEGER)) AS INTEGER) AS level_max FROM m GROUP BY pair
    """
)
def q22_diff_map(spark: SparkSession, d: str) -> DataFrame:
    """The difference map of pairs in levels, summed up."""

    def level(c):
        both = (c["l"] > LEVEL) & (c["r"] > LEVEL)
        one = (c["l"] > LEVEL) != (c["r"] > LEVEL)
        hue = S.hue_distance(F.abs(c["l"] - c["r"]) % 180, F.lit(0), 180).cast("double")
        return S.to_byte_level(S.pixel_difference(hue, both, one.cast("int")))

    maps = _pairs(spark, d).select("pair", F.transform(F.arrays_zip("l", "r"), level).alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda s, v: s + v)
    return maps.select("pair", total.alias("level_sum"), F.array_max("m").alias("level_max"))


@query(
    """
    WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS l, b.embedding::DOUBLE[] AS r FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0)
    SELECT vec_id, CAST(4 * len(l) AS INTEGER) AS width, round(list_sum(l), 4) AS left_sum, round(list_sum(list_transform(list_zip(l, r), lambda z: abs(z[1] - z[2]))), 4) AS difference_sum,
           round(list_dot_product(l, r), 4) AS product_sum, round(list_cosine_similarity(l, r), 6) AS cosine FROM v
    """
)
def q23_vector_repr(spark: SparkSession, d: str) -> DataFrame:
    """Both vectors, their difference and product as one vector of a pair, in parts."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    l = e.where(F.col("vec_id") % 2 == 0).select("vec_id", F.col("embedding").alias("l"))
    r = e.where(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r"))
    both = l.join(r, "vec_id").withColumn("v", S.pair_vector(F.col("l"), F.col("r")))

    def part(i: int):
        return F.round(F.aggregate(F.slice("v", 64 * i + 1, 64), F.lit(0.0), lambda s, x: s + x), 4)

    return both.select(
        "vec_id", F.size("v").alias("width"), part(0).alias("left_sum"), part(2).alias("difference_sum"), part(3).alias("product_sum"),
        F.round(S.cosine(F.col("l"), F.col("r")), 6).alias("cosine"),
    )


@query(
    """
    SELECT vec_id, 66 AS width, round(p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END, 4) AS explicit_sum, round(list_sum(embedding::DOUBLE[]), 4) AS embedding_sum,
           round(embedding[64]::DOUBLE, 6) AS last FROM embeddings JOIN part ON p_partkey = vec_id
    """
)
def q29_fused_vector(spark: SparkSession, d: str) -> DataFrame:
    """Explicit numbers and an embedding as one vector, in parts; a number that is not finite counts as 0."""
    p = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    price = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    e = table(spark, d, "embeddings", "vec_id", "embedding").join(p, F.col("vec_id") == F.col("p_partkey"))
    v = e.select("vec_id", S.fused_vector([F.col("p_size"), price], F.col("embedding")).alias("v"))
    total = lambda a, n: F.round(F.aggregate(F.slice("v", a, n), F.lit(0.0), lambda s, x: s + x), 4)
    return v.select("vec_id", F.size("v").alias("width"), total(1, 2).alias("explicit_sum"), total(3, 64).alias("embedding_sum"), F.round(F.col("v")[65], 6).alias("last"))


@query(f"WITH {_G} SELECT vec_id, y, x, p, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY y, x) AS INTEGER) AS ordinal FROM g")
def q31_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in reading order; an array's positions give the number without a sort."""
    g = _grids(spark, d).select("vec_id", F.posexplode("p").alias("i", "p"))
    return g.select("vec_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), "p", (F.col("i") + 1).alias("ordinal"))


@query(
    f"""
    WITH {_G} SELECT vec_id, count(*) FILTER (WHERE p > {LEVEL}) AS n, round(coalesce(avg(x) FILTER (WHERE p > {LEVEL}), 0) / 8, 6) AS cx,
             round(coalesce(avg(y) FILTER (WHERE p > {LEVEL}), 0) / 8, 6) AS cy FROM g GROUP BY vec_id
    """
)
def q47_centroid(spark: SparkSession, d: str) -> DataFrame:
    def centre(cells: np.ndarray) -> dict:
        m = cells > LEVEL
        n = m.sum((1, 2))
        y, x = np.mgrid[:8, :8]
        return dict(n=n, cx=(m * x).sum((1, 2)) / np.maximum(n, 1) / 8, cy=(m * y).sum((1, 2)) / np.maximum(n, 1) / 8)

    out = grids.per_grid(_grids(spark, d), "vec_id", "p", centre, "n long,cx double,cy double")
    return out.select("vec_id", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"WITH {_G} SELECT vec_id, count(*) FILTER (WHERE {_DISK}) AS n_disk, count(*) FILTER (WHERE {_DISK} AND p > {LEVEL}) AS n_active FROM g GROUP BY vec_id")
def q70_mask_counts(spark: SparkSession, d: str) -> DataFrame:
    disk = shapes.disk(8, 8)

    def counts(cells: np.ndarray) -> dict:
        return dict(n_disk=np.full(len(cells), int(disk.sum()), np.int64), n_active=((cells > LEVEL) & disk).sum((1, 2)))

    return grids.per_grid(_grids(spark, d), "vec_id", "p", counts, "n_disk long,n_active long")


def _stencil_sql(source: str, column: str, op: str) -> str:
    return f"""(SELECT a.vec_id, a.y, a.x, {op}(b.{column}) AS m FROM {source} a JOIN {source} b ON a.vec_id = b.vec_id AND b.y BETWEEN a.y - 1 AND a.y + 1
               AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)"""


@query(
    f"""
    WITH {_G}, m0 AS (SELECT vec_id, y, x, p > {LEVEL} AS m FROM g), e AS {_stencil_sql("m0", "m", "bool_and")}, o AS {_stencil_sql("e", "m", "bool_or")},
    d AS {_stencil_sql("o", "m", "bool_or")}, c AS {_stencil_sql("d", "m", "bool_and")}
    SELECT vec_id, count(*) FILTER (WHERE o.m) AS n_opened, count(*) FILTER (WHERE c.m) AS n_closed FROM o JOIN c USING (vec_id, y, x) GROUP BY vec_id
    """
)
def q71_open_close(spark: SparkSession, d: str) -> DataFrame:
    def work(cells: np.ndarray) -> dict:
        o = grids.dilated(grids.eroded(cells > LEVEL))
        c = grids.eroded(grids.dilated(o))
        return dict(n_opened=o.sum((1, 2)), n_closed=c.sum((1, 2)))

    return grids.per_grid(_grids(spark, d), "vec_id", "p", work, "n_opened long,n_closed long")


_COMPONENTS = f"""m0 AS (SELECT vec_id, y * 8 + x AS k, y, x FROM g WHERE p > {LEVEL}),
    reach AS (SELECT vec_id, k AS s, k, y, x FROM m0
              UNION SELECT r.vec_id, r.s, n.k, n.y, n.x FROM reach r JOIN m0 n ON n.vec_id = r.vec_id AND n.y BETWEEN r.y - 1 AND r.y + 1 AND n.x BETWEEN r.x - 1 AND r.x + 1),
    lab AS (SELECT vec_id, s, min(k) AS l FROM reach GROUP BY ALL), sizes AS (SELECT vec_id, l, count(*) AS n FROM lab GROUP BY ALL)"""


@query(
    f"""
    WITH RECURSIVE {_G}, {_COMPONENTS}
    SELECT e.vec_id, count(n) AS n_components, CAST(coalesce(max(n), 0) AS BIGINT) AS largest, CAST(coalesce(sum(n) FILTER (WHERE n >= 4), 0) AS BIGINT) AS kept
    FROM embeddings e LEFT JOIN sizes s ON s.vec_id = e.vec_id GROUP BY ALL
    """
)
def q72_components(spark: SparkSession, d: str) -> DataFrame:
    def work(cells: np.ndarray) -> dict:
        sizes = grids.component_sizes(cells > LEVEL)
        of = lambda f: np.array([f(s) for s in sizes], np.int64)
        return dict(n_components=of(len), largest=of(lambda s: s.max(initial=0)), kept=of(lambda s: s[s >= 4].sum()))

    return grids.per_grid(_grids(spark, d), "vec_id", "p", work, "n_components long,largest long,kept long")


@query(
    f"""
    WITH {_G}, m0 AS (SELECT vec_id, y, x FROM g WHERE p > {LEVEL}),
    n AS (SELECT a.vec_id, a.y, a.x, count(b.x) - 1 AS n FROM m0 a JOIN m0 b ON a.vec_id = b.vec_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)
    SELECT e.vec_id, count(n) AS length, count(*) FILTER (WHERE n >= 3) AS branches, count(*) FILTER (WHERE n = 1) AS ends FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id GROUP BY ALL
    """
)
def q73_branch_endpoints(spark: SparkSession, d: str) -> DataFrame:
    def work(cells: np.ndarray) -> dict:
        m = cells > LEVEL
        n = grids.around(m)
        return dict(length=m.sum((1, 2)), branches=(m & (n >= 3)).sum((1, 2)), ends=(m & (n == 1)).sum((1, 2)))

    return grids.per_grid(_grids(spark, d), "vec_id", "p", work, "length long,branches long,ends long")


@query(
    f"""
    WITH {_G}, l AS (SELECT a.vec_id, a.y, a.x, CAST(sum(b.p) - 4 * any_value(a.p) AS BIGINT) AS v FROM g a,
        (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx), g b
        WHERE b.vec_id = a.vec_id AND b.y = CASE a.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.y + dy END AND b.x = CASE a.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.x + dx END GROUP BY ALL)
    SELECT vec_id, CAST(64 * sum(v * v) - sum(v) * sum(v) AS BIGINT) AS numerator FROM l GROUP BY vec_id
    """
)
def q74_laplacian_var(spark: SparkSession, d: str) -> DataFrame:
    work = lambda cells: dict(numerator=grids.laplacian_numerator(cells))
    return grids.per_grid(_grids(spark, d), "vec_id", "p", work, "numerator long")


@query(
    f"""
    WITH {_G}, c AS (SELECT *, (x - 4) * (x - 4) + (y - 4) * (y - 4) AS q FROM g),
    s AS (SELECT vec_id, count(*) FILTER (WHERE q <= 7.29) AS n_inside, sum(p) FILTER (WHERE q <= 7.29) AS s_inside, count(*) FILTER (WHERE q >= 9.3636 AND q <= 13.3956) AS n_ring,
                 sum(p) FILTER (WHERE q >= 9.3636 AND q <= 13.3956) AS s_ring, count(*) FILTER (WHERE q <= 7.29 AND p < 160) AS n_dark FROM c GROUP BY vec_id)
    SELECT vec_id, round(s_inside / n_inside, 6) AS mean_inside, round(s_ring / n_ring, 6) AS mean_ring, round(s_ring / n_ring - s_inside / n_inside, 6) AS contrast, round(n_dark / n_inside, 6) AS dark
    FROM s WHERE n_inside >= 20 AND n_ring >= 4 AND n_dark / n_inside > 0.75
    """
)
def q75_circle_score(spark: SparkSession, d: str) -> DataFrame:
    """Means inside and around a circle of radius 3 in the middle, of grids that are dark enough inside."""
    y, x = np.mgrid[:8, :8]
    q = (x - 4) ** 2 + (y - 4) ** 2
    inside, ring = q <= 7.29, (q >= 9.3636) & (q <= 13.3956)

    def work(cells: np.ndarray) -> dict:
        a, b = cells[:, inside], cells[:, ring]
        mi, mr = a.mean(1), b.mean(1)
        return dict(mean_inside=mi, mean_ring=mr, contrast=mr - mi, dark=(a < 160).mean(1), n=np.full(len(cells), inside.sum()), m=np.full(len(cells), ring.sum()))

    out = grids.per_grid(_grids(spark, d), "vec_id", "p", work, "mean_inside double,mean_ring double,contrast double,dark double,n long,m long")
    names = ("mean_inside", "mean_ring", "contrast", "dark")
    return out.where("n >= 20 and m >= 4 and dark > 0.75").select("vec_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    f"""
    WITH {_G}, s AS (SELECT vec_id, stddev_pop(p) AS sharpness, avg(CAST(p >= 200 AS DOUBLE)) AS bright, avg(CAST(p <= 110 AS DOUBLE)) AS dark, avg(CAST(p >= 190 AS DOUBLE)) AS saturated,
                 quantile_cont(p, 0.95) - quantile_cont(p, 0.05) AS contrast, avg(CAST(p > {LEVEL} AS DOUBLE)) AS response FROM g GROUP BY vec_id),
    f AS (SELECT vec_id, sharpness < 20 AS f1, bright > 0.08 AS f2, dark > 0.85 AS f3, saturated > 0.2 AS f4, contrast < 12 AS f5, response < 0.005 AS f6, response > 0.85 AS f7 FROM s)
    SELECT vec_id, CASE WHEN f2::INT + f3::INT + f5::INT >= 2 THEN 'REJECT_REFERENCE_QC' WHEN f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 THEN 'REVIEW' ELSE 'PASS_REFERENCE_QC' END AS status,
           coalesce(nullif(concat_ws(', ', CASE WHEN f1 THEN 'LOW_SHARPNESS' END, CASE WHEN f2 THEN 'BRIGHT_CLIPPING' END, CASE WHEN f3 THEN 'VERY_DARK_PLATE' END, CASE WHEN f4 THEN 'SATURATION_CLIPPING' END,
           CASE WHEN f5 THEN 'LOW_CONTRAST' END, CASE WHEN f6 THEN 'VERY_LOW_THERMOCHROMIC_RESPONSE' END, CASE WHEN f7 THEN 'POSSIBLE_OVER_RESPONSE' END), ''), 'None') AS flags FROM f
    """
)
def q76_qc_status(spark: SparkSession, d: str) -> DataFrame:
    def work(cells: np.ndarray) -> dict:
        v = cells.reshape(len(cells), -1)
        p = np.percentile(v, [5, 95], axis=1)
        share = lambda m: m.mean(1)
        return dict(sharpness=v.std(1), bright=share(v >= 200), dark=share(v <= 110), saturated=share(v >= 190), contrast=p[1] - p[0], response=share(v > LEVEL))

    names = ("sharpness", "bright", "dark", "saturated", "contrast", "response")
    m = grids.per_grid(_grids(spark, d), "vec_id", "p", work, ",".join(f"{n} double" for n in names))
    flagged = m.select("vec_id", S.qc_flags(*[F.col(n) for n in names]).alias("f"))
    return flagged.select("vec_id", S.qc_status(F.col("f")).alias("status"), S.joined_or(F.col("f")).alias("flags"))


@query(
    """
    SELECT plate_id, ingested_at, count(*) AS n, max(CASE WHEN a < 0.02 THEN 'minimal-response' WHEN c >= 5 AND l < 0.12 THEN 'scattered' WHEN e >= 3 AND a < 0.22 THEN 'linear-like'
           WHEN b >= 8 AND e >= 1.6 THEN 'branched/complex' WHEN a >= 0.30 THEN 'diffuse/large-region' WHEN l >= 0.08 THEN 'focal/irregular-region' ELSE 'mixed' END) AS label
    FROM (SELECT plate_id, ingested_at, response_area_fraction AS a, component_count AS c, largest_component_fraction AS l, largest_elongation AS e, branch_pixels AS b FROM features_v0_1) GROUP BY ALL
    """
)
def q77_morphology(spark: SparkSession, d: str) -> DataFrame:
    """The descriptor that the rules give each reading of a plate."""
    names = ("response_area_fraction", "component_count", "largest_component_fraction", "largest_elongation", "branch_pixels")
    rows = table(spark, d, "features_v0_1", "plate_id", "ingested_at", *names)
    return rows.groupBy("plate_id", "ingested_at").agg(F.count("*").alias("n"), F.max(S.morphology(*[F.col(c) for c in names])).alias("label"))


@query(
    f"""
    WITH RECURSIVE {_G}, {_COMPONENTS}, t AS (SELECT vec_id, count(*) AS n, max(n) AS largest, sum(n) AS total FROM sizes GROUP BY vec_id)
    SELECT e.vec_id, round(coalesce(total, 0) / 64, 6) AS area_fraction, coalesce(n, 0) AS component_count, round(coalesce(largest, 0) / 64, 6) AS largest_fraction
    FROM embeddings e LEFT JOIN t ON t.vec_id = e.vec_id
    """
)
def q78_signal_features(spark: SparkSession, d: str) -> DataFrame:
    def work(cells: np.ndarray) -> dict:
        sizes = grids.component_sizes(cells > LEVEL)
        share = lambda f: np.round(np.array([f(s) for s in sizes]) / 64, 6)
        return dict(area_fraction=share(np.sum), component_count=np.array([len(s) for s in sizes]), largest_fraction=share(lambda s: s.max(initial=0)))

    return grids.per_grid(_grids(spark, d), "vec_id", "p", work, "area_fraction double,component_count long,largest_fraction double")


@query(
    f"""
    WITH {_PAIRS} SELECT pair, n_both, n_either, n_one, round(xor_share, 6) AS xor_fraction, round(abs(area), 6) AS area_delta, round(jaccard, 6) AS jaccard, round(hue, 6) AS mean_hue, {_SCORE} AS score,
    CAST(NULL AS DOUBLE) AS clinical_risk, 'NONE' AS clinical_claim FROM ({_PAIR_SHARES})
    """
)
def q79_pair_compare(spark: SparkSession, d: str) -> DataFrame:
    """The whole record of a pair of grids."""
    p = _pair_scores(spark, d)
    rounded = [F.round(F.col(a), 6).alias(b) for a, b in (("xor_share", "xor_fraction"), ("jaccard", "jaccard"), ("hue", "mean_hue"))]
    return p.select("pair", "n_both", "n_either", "n_one", F.round(F.abs("area"), 6).alias("area_delta"), *rounded, "score").withColumns(S.guardrails())


_PLATES = f"""{_G}, img AS (SELECT vec_id, y * 4 + dy AS y, x * 4 + dx AS x,
        CASE WHEN (x * 4 + dx - 16) ** 2 + (y * 4 + dy - 16) ** 2 <= 81 THEN p ELSE least(255, p + 100) END AS p
        FROM g, (SELECT unnest(range(4)) AS dy), (SELECT unnest(range(4)) AS dx)),
    c AS (SELECT p_partkey AS id, 14 + p_partkey % 5 AS cx, 14 + p_partkey // 5 % 5 AS cy, 1 + p_size % 14 AS r FROM part WHERE p_partkey <= 40)"""


@query(
    f"""
    WITH {_PLATES}, q AS (SELECT vec_id, id, r, p, (x - cx) ** 2 + (y - cy) ** 2 AS q FROM img, c),
    s AS (SELECT vec_id, id, count(*) FILTER (WHERE q <= (0.9 * r) ** 2) AS n, count(*) FILTER (WHERE q >= (1.02 * r) ** 2 AND q <= (1.22 * r) ** 2) AS m,
                 avg(p) FILTER (WHERE q <= (0.9 * r) ** 2) AS a, avg(p) FILTER (WHERE q >= (1.02 * r) ** 2 AND q <= (1.22 * r) ** 2) AS b,
                 avg(CAST(p < 160 AS DOUBLE)) FILTER (WHERE q <= (0.9 * r) ** 2) AS dark FROM q GROUP BY vec_id, id)
    SELECT vec_id, id, round(a, 6) AS mean_inside, round(b, 6) AS mean_ring, round(b - a, 6) AS contrast, round(dark, 6) AS dark, b - a > 85 AND dark > 0.75 AND b > 170 AS accepted
    FROM s WHERE n >= 20 AND m >= 20
    """
)
def q80_circle_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Forty circles scored on each image of a plate: enough pixels inside and around, then contrast, darkness and ring by the rule.

    The images' own contrast is about 100, so the least contrast asked for here is 85.
    """
    circles = table(spark, d, "part", "p_partkey", "p_size").where("p_partkey <= 40")
    c = circles.select(F.col("p_partkey").alias("id"), (14 + F.col("p_partkey") % 5).alias("x"), F.expr("14 + p_partkey div 5 % 5").alias("y"), (1 + F.col("p_size") % 14).alias("r"))
    shared = sorted(tuple(r) for r in c.collect())  # the circles of an image: forty
    yy, xx = np.mgrid[:32, :32]
    plate = (xx - 16) ** 2 + (yy - 16) ** 2 <= 81

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
            out = []
            for i, g in zip(ids, cells.repeat(4, 1).repeat(4, 2)):
                img = np.where(plate, g, np.minimum(255, g + 100))
                for k, x, y, r in shared:
                    score = shapes.circle_score(img, x, y, r)
                    if score:
                        out.append((i, k, *score, plates.accepted(score, contrast=85)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.bool_()]
    names = ["vec_id", "id", "mean_inside", "mean_ring", "contrast", "dark", "accepted"]
    out = _grids(spark, d).mapInArrow(work, "vec_id long, id long, mean_inside double, mean_ring double, contrast double, dark double, accepted boolean")
    return out.select("vec_id", "id", *[F.round(n, 6).alias(n) for n in names[2:6]], "accepted")


@query(
    f"""
    WITH {_G}, t AS (SELECT a.vec_id, a.y, a.x, coalesce(b.p, 0) AS p FROM g a LEFT JOIN g b ON b.vec_id = a.vec_id AND b.x = a.x - (a.vec_id % 5 - 2) AND b.y = a.y - (a.vec_id // 5 % 5 - 2))
    SELECT vec_id, CAST(sum(p) AS BIGINT) AS level_sum, CAST(sum(p * (8 * y + x)) AS BIGINT) AS weighted FROM t GROUP BY vec_id
    """
)
def q81_translate(spark: SparkSession, d: str) -> DataFrame:
    """Grids shifted by whole pixels, zero outside."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
            moved = np.array([filters.translate(g, int(i % 5 - 2), int(i // 5 % 5 - 2)) for i, g in zip(ids, cells)]).reshape(-1, 64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved.sum(1)), pa.array(moved @ np.arange(64))], ["vec_id", "level_sum", "weighted"])

    return _grids(spark, d).mapInArrow(work, "vec_id long, level_sum long, weighted long")


@query(
    """
    SELECT vec_id, CAST(vec_id % 7 - 3 AS INTEGER) AS dx, CAST(vec_id // 7 % 7 - 3 AS INTEGER) AS dy FROM embeddings
    """
)
def q82_register(spark: SparkSession, d: str) -> DataFrame:
    """The shift of a picture that was turned around its edges by a known distance, from phase correlation."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.float64)
            found = []
            for i, g in zip(ids, cells.repeat(2, 1).repeat(2, 2)):
                g = g + np.add.outer(np.arange(16) % 3, np.arange(16) % 5)
                x, y, _ = filters.phase_shift(g, np.roll(g, (int(i // 7 % 7 - 3), int(i % 7 - 3)), (0, 1)))
                found.append((int(np.rint(x)), int(np.rint(y))))
            x, y = np.array(found, np.int32).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(y)], ["vec_id", "dx", "dy"])

    return _grids(spark, d).mapInArrow(work, "vec_id long, dx int, dy int")


@query(
    f"""
    WITH {_PAIRS}, h AS (SELECT pair, least(abs(l - r) % 180, 180 - abs(l - r) % 180) AS d FROM pp WHERE ml AND mr)
    SELECT pair, count(*) AS n, round(quantile_cont(d, 0.9), 6) AS p90 FROM h GROUP BY pair
    """
)
def q83_pair_p90(spark: SparkSession, d: str) -> DataFrame:
    """The ninetieth percentile of the hue distance where both of a pair respond."""
    z = F.filter(F.arrays_zip("l", "r"), lambda c: (c["l"] > LEVEL) & (c["r"] > LEVEL))
    h = _pairs(spark, d).select("pair", F.array_sort(F.transform(z, lambda c: S.hue_distance(F.abs(c["l"] - c["r"]) % 180, F.lit(0), 180).cast("double"))).alias("h"))
    at = 0.9 * (F.size("h") - 1)
    low, high = F.get("h", F.floor(at).cast("int")), F.get("h", F.ceil(at).cast("int"))
    h = h.where(F.size("h") > 0).select("pair", F.size("h").cast("long").alias("n"), (low + (at - F.floor(at)) * (high - low)).alias("p90"))
    return h.select("pair", "n", F.round("p90", 6).alias("p90"))
