"""Score cutoffs that keep a target fraction of each group, by iterative histogram refinement.

A round counts the scores of every group into equal bins between the group's bounds, walks the bins from the top
until the target rank is reached, and makes the smallest and the largest score of that bin the next bounds. A group is
done when the bin holds one value, or ends at the target rank exactly. Bins are combined on the map side, so a group of
any size costs at most ``BINS`` rows for each partition; no group's scores come together in one task. Each round
divides a group's range by ``BINS``, so two or three rounds are usual, and the number of rounds does not depend on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.common import checked_broadcast, cut

BINS = 1_024
#: Tolerance when a fraction of a count is rounded up, so that 0.1 x 30 means 3.
ROUNDING = 1e-9


def usable_scores(df: DataFrame, group: str, score: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows with a group and a score in ``low``..``high``; null and NaN scores fall out."""
    s = F.col(score)
    return df.where(F.col(group).isNotNull() & s.isNotNull() & ~F.isnan(s) & (s >= low) & (s <= high))


def refine_cutoffs(scores: DataFrame, targets: DataFrame, group: str, score: str, fraction: str, bins: int = BINS) -> DataFrame:
    """For each group with a target and usable scores: ``group``, ``cutoff``, ``n`` and ``kept``.

    With n usable scores the cutoff is the ceil(fraction x n)-th highest score; scores at or above it are kept, ties
    included. Fractions above 1 count as 1; null, NaN, zero and negative ones give no row. Of several targets of a group the
    largest counts. ``scores`` must hold usable scores only (see :func:`usable_scores`) and is read once in each round,
    so pass a checkpointed frame. Empty inputs give an empty result.
    """
    f = F.col(fraction)
    wanted = targets.where(F.col(group).isNotNull() & f.isNotNull() & ~F.isnan(f) & (f > 0)).groupBy(group).agg(F.max(f).alias("_f"))
    data = scores.select(group, F.col(score).alias("_s"))
    totals = data.groupBy(group).agg(F.count("*").alias("n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    need = F.greatest(F.lit(1), F.ceil(F.least(F.col("_f"), F.lit(1.0)) * F.col("n") - ROUNDING)).cast("long")
    state = cut(
        totals.join(wanted, group)
        .withColumn("_need", need)
        .withColumn("_above", F.lit(0).cast("long"))
        .withColumn("_inside", F.col("n"))
        .withColumn("_done", (F.col("_lo") == F.col("_hi")) | (F.col("_need") == F.col("n")))
        .drop("_f")
    )
    w = Window.partitionBy(group)
    top_down = w.orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not state.where(~F.col("_done")).isEmpty():
        todo = checked_broadcast(state.where(~F.col("_done")))
        width = F.col("_hi") - F.col("_lo")
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col("_s") - F.col("_lo")) / width * bins))
        counted = (
            data.join(todo, group)
            .where((F.col("_s") >= F.col("_lo")) & (F.col("_s") <= F.col("_hi")))
            .groupBy(group, bin_of.cast("int").alias("_bin"))
            .agg(
                F.count("*").alias("_c"),
                F.min("_s").alias("_blo"),
                F.max("_s").alias("_bhi"),
                *[F.first(c).alias(c) for c in ("n", "_need", "_above")],
            )
            .withColumn("_cum", F.sum("_c").over(top_down) + F.col("_above"))
        )
        chosen = (
            counted.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_c") < F.col("_need")))
            .select(
                group,
                "n",
                F.col("_blo").alias("_lo"),
                F.col("_bhi").alias("_hi"),
                "_need",
                (F.col("_cum") - F.col("_c")).alias("_above"),
                F.col("_c").alias("_inside"),
            )
            .withColumn("_done", (F.col("_lo") == F.col("_hi")) | (F.col("_above") + F.col("_inside") == F.col("_need")))
        )
        state = cut(state.where(F.col("_done")).unionByName(chosen.select(*state.columns)))
    return state.select(group, F.col("_lo").alias("cutoff"), "n", (F.col("_above") + F.col("_inside")).alias("kept"))


def keep_above(scores: DataFrame, cutoffs: DataFrame, group: str, score: str) -> DataFrame:
    """The rows of ``scores`` at or above their group's cutoff."""
    limits = cutoffs.select(F.col(group).alias("_group"), F.col("cutoff").alias("_cutoff"))
    kept = scores.join(checked_broadcast(limits), F.col(group) == F.col("_group"))
    return kept.where(F.col(score) >= F.col("_cutoff")).select(*scores.columns)
