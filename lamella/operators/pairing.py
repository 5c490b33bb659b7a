"""Lookups with defaults, positional pairing of sides, and greedy suppression of overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.raster import shapes

#: Ids of circles of one place and size that are kept in one list, and lists of a grid cell that are compared by one key of the join.
SAME_CIRCLES = 64
CELL_ROWS = 2_000


def last_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of the rows sharing ``keys`` the last by ``order``, nulls first; of rows that tie in it the greatest by all columns. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_{i}") for i, o in enumerate(order)], *rest)
    best = df.groupBy(*keys).agg(F.max(place).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def lookup_with_default(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join in which missing matches and null cells take the defaults. ``lookup`` has one row for each key."""
    joined = df.join(lookup.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def upload_lookup(metadata: DataFrame, text: str) -> DataFrame:
    """Upload metadata texts as a row for each file name, normalised; items without a name are left out, the last of a name wins."""
    items = metadata.select(F.posexplode(S.upload_items(F.col(text))).alias("ordinal", "item")).where("item.filename is not null")
    rows = items.select(
        "ordinal",
        "item.filename",
        S.normalized_side(F.col("item.side")).alias("side"),
        F.col("item.position").alias("position"),
        F.col("item.sequence_index").try_cast("int").alias("sequence_index"),
        S.profile_or_default(F.col("item.tlc_profile_id")).alias("tlc_profile_id"),
        F.col("item.device_profile_id").alias("device_profile_id"),
    )
    return last_wins(rows, ["filename"], ["ordinal"]).drop("ordinal")


def zip_pairs(df: DataFrame, group: list[str], side: str, left: str, right: str, order: list[str], values: list[str]) -> DataFrame:
    """The n-th left row of a group with its n-th right row; surplus rows of either side are dropped.

    One shuffle: rows are numbered for each group and side, and the two sides of a number are put together by aggregation. Columns
    ``values`` come back with ``left_`` and ``right_`` before their names, and ``ordinal`` from 1.
    """
    numbered = (
        df.where(F.col(side).isin(left, right))
        .select(*group, side, *dict.fromkeys([*order, *values]))
        .withColumn("ordinal", F.row_number().over(Window.partitionBy(*group, side).orderBy(*order)))
    )
    is_left = F.col(side) == left
    picked = []
    for prefix, own in (("left_", is_left), ("right_", ~is_left)):
        picked += [F.max(F.when(own, F.struct(*values))).alias(f"_{prefix}")]
    both = numbered.groupBy(*group, "ordinal").agg(*picked).where(F.col("_left_").isNotNull() & F.col("_right_").isNotNull())
    return both.select(*group, "ordinal", *[F.col(f"_{p}")[v].alias(p + v) for p in ("left_", "right_") for v in values])


def pair_names(df: DataFrame, exam: Column, partition: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``bilateral_pair_id``: the exam's id and a number within it."""
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("bilateral_pair_id", F.format_string("%s-BP-%03d", exam, number))


def overlapping_circles(df: DataFrame, group: str, digits: int | None = None) -> DataFrame:
    """Pairs of circles (``id``, ``x``, ``y``, ``r``) of a group that overlap: ``id_a``, ``id_b`` (the smaller first) and ``iou``.

    Only circles in neighbouring cells of a grid as wide as the group's largest circle meet; its size is taken from the data. Circles
    of one place and size meet the others together, in lists of at most ``SAME_CIRCLES`` ids, so an overlap is computed once for all of
    them; pairs too far apart are left out before. The circles of a cell are divided into blocks of about ``CELL_ROWS`` lists, so
    a full cell is many keys of the join. The result is as long as there are overlapping pairs, quadratic in the circles of a crowded image.
    With ``digits`` an ``iou`` is rounded, and left out if it becomes 0.
    """
    spark = df.sparkSession
    place = [group, "x", "y", "r"]
    ordinal = F.row_number().over(Window.partitionBy(*place).orderBy("id"))
    lists = df.select(group, "id", "x", "y", "r").where("id is not null").withColumn("_list", F.floor((ordinal - 1) / SAME_CIRCLES))
    lists = lists.groupBy(*place, "_list").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    widest = df.groupBy(group).agg(F.greatest(2 * F.max("r"), F.lit(1e-9)).alias("_cell"))
    cells = lists.join(widest, group).select(*place, "ids", *[F.floor(F.col(c) / F.col("_cell")).alias(f"_{c}") for c in ("x", "y")])
    blocks = cells.groupBy(group, "_x", "_y").agg(F.ceil(F.count("*") / CELL_ROWS).alias("_blocks"))
    a = cells.join(blocks, [group, "_x", "_y"]).withColumn("_block", F.pmod(F.xxhash64("x", "y", "r", "ids"), "_blocks")).drop("_blocks")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = cells.select(group, *[F.col(n).alias(n + "_b") for n in ("ids", "x", "y", "r")], "_x", "_y", F.explode(around).alias("_o"))
    b = b.withColumns({"_x": F.col("_x") + F.col("_o.i"), "_y": F.col("_y") + F.col("_o.j")}).drop("_o").join(blocks, [group, "_x", "_y"])
    b = b.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    # the work follows the pairs, not the bytes: a fixed number of tasks, and no broadcast
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [group, "_x", "_y", "_block"]
    met = a.repartition(tasks, *keys).hint("merge").join(b.repartition(tasks, *keys), keys)
    dx, dy, reach = F.col("x") - F.col("x_b"), F.col("y") - F.col("y_b"), F.col("r") + F.col("r_b")
    met = met.where((F.get("ids", F.lit(0)) < F.element_at("ids_b", -1)) & (dx * dx + dy * dy <= reach * reach * (1 + 1e-9)))
    # columns of their own, and the last one exploded, so that nothing is computed twice
    met = met.select(group, "ids", "ids_b", "r", "r_b", F.hypot(dx, dy).alias("_d"))
    met = met.withColumn("_shared", S.circle_shared(F.col("_d"), F.col("r"), F.col("r_b")))
    iou = S.iou_of_shared(*[F.col(n) for n in ("_shared", "_d", "r", "r_b")])
    iou = iou if digits is None else F.round(iou, digits)
    over = met.select(group, "ids", "ids_b", F.explode(F.array(iou)).alias("iou")).where("iou > 0")
    pairs = over.select(group, F.explode("ids").alias("id_a"), "ids_b", "iou").select(group, "id_a", F.explode("ids_b").alias("id_b"), "iou")
    return pairs.where("id_a < id_b")


def greedy_circles(df: DataFrame, group: list[str], limit: float = 0.35) -> DataFrame:
    """Circles (``id``, ``x``, ``y``, ``r``, ``score``) of a group that overlap no better one that was kept by ``limit`` or more.

    Better is a higher score, then a smaller id. The decision depends on what was kept before, so the circles of a group are gone through in one
    Arrow batch, best first; each is compared with the kept ones in the cells around it, so the work follows the number of circles. A group is
    one image: its circles are a few numbers each, and what is kept is bounded by the image's area.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*group, "id", "x", "y", "r", "score"]

    def run(table: pa.Table) -> pa.Table:
        x, y, r, score = (table.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "r", "score"))
        order = np.lexsort((table.column("id").to_numpy(), -score))
        kept = order[shapes.suppress_overlaps(np.column_stack([x, y, r])[order], limit)]
        return table.select(names).take(pa.array(np.sort(kept)))

    return df.groupBy(*group).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
