"""Exact percentiles of groups of any size, by histograms that zoom in.

A percentile with linear interpolation lies between two values of known rank. A round counts the values of every group within the
intervals that still hold a wanted rank into ``BINS`` bins, with map-side combination, and the bin with the rank becomes the next interval,
until it holds one value. A group of any size costs at most ``BINS`` rows for each interval and partition, and no group's values come
together in one task. Bins of the first round are equal on a scale that is linear near zero and logarithmic beyond, so far
outliers cost no rounds; later ones are equal. Usually two or three rounds are enough, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.common import BROADCAST_ROWS, cut

BINS = 4_096


def exact_percentiles(df: DataFrame, by: list[str], value: Column, shares: list[float], name: str = "percentiles") -> DataFrame:
    """``by`` and an array ``name`` with the values at ``shares`` (0 to 1) of each group, linearly interpolated.

    Null, NaN and infinite values do not count; a group without others has no row. A null in ``by`` is a group; without ``by`` there is one
    row. ``df`` is read once in each round. Empty inputs give an empty result.
    """
    v = value.cast("double")
    data = df.select(F.struct(*by, F.lit(0).alias("_")).alias("_g"), v.alias("_v")).where(~F.isnan("_v") & (F.abs("_v") < float("inf")))
    totals = data.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[r.cast("long") for p in place for r in (F.floor(p), F.ceil(p))]))
    totals = cut(totals)
    state = totals.select("_g", F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    scale = F.asinh
    while True:
        open_ = state.where("_lo < _hi")
        left = open_.count()
        if not left:
            break
        wide = open_.select("_g", "_lo", "_hi").distinct()
        wide = F.broadcast(wide) if left <= BROADCAST_ROWS else wide
        lo, hi = scale(F.col("_lo")), scale(F.col("_hi"))
        bin_of = F.least(F.lit(BINS - 1), F.floor((scale(F.col("_v")) - lo) / (hi - lo) * BINS)).cast("int")
        counted = (
            data.join(wide, "_g")
            .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
            .groupBy("_g", "_lo", "_hi", bin_of.alias("_bin"))
            .agg(F.count("*").alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        )
        upwards = Window.partitionBy("_g", "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("_upto", F.sum("_c").over(upwards))
        within = (F.col("_below") + F.col("_upto") > F.col("_rank")) & (F.col("_below") + F.col("_upto") - F.col("_c") <= F.col("_rank"))
        narrower = open_.join(counted, ["_g", "_lo", "_hi"]).where(within)
        narrower = narrower.select("_g", "_rank", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"))
        state = cut(state.where("_lo = _hi").unionByName(narrower))
        scale = lambda c: c
    found = state.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))  # two for each share
    out = []
    for p in place:
        a, b = (F.col("_at")[f(p).cast("long")] for f in (F.floor, F.ceil))
        out.append(a + (p - F.floor(p)) * (b - a))
    return totals.select("_g", "n").join(found, "_g").select(*[F.col("_g")[c].alias(c) for c in by], F.array(*out).alias(name))
