"""Grouping records into clusters of mutually similar records, by reciprocal-nearest-neighbour average linkage.

Records are points: a category and some numbers, each on its own scale (plain, by ratio, or on a circle).

1. *Nodes.* Points of a category that share a cell of the grid of scales are the first clusters: they are several times closer to each
   other than the distance at which similarity ends. Cells are aggregated with map-side combination to a count, means and variances, so a
   category or a crowd of any size costs one row for each cell and partition. For axes between two bounds, by ratio (a double spans 1,420
   powers of e) or on a circle the number of cells has a bound that does not depend on the number of points.
2. *Background.* A crowd is set apart by nearly empty space. The density of that space is estimated by clipping: the points of a category
   over the cells of its space, again without the cells that are too full for that density to be chance, until nothing changes. Cells whose
   neighbourhood chance could have filled are not linked. No share of the category decides: five records in empty space are a crowd
   beside millions elsewhere.
3. *Sparse graph.* Nodes up to ``STEPS`` cells apart in each axis are linked.
4. *Rounds.* The similarity of two points is 1 less their squared distance over the squared ``REACH``; that of two clusters is the mean over
   all pairs of their points, which follows exactly from the clusters' means and variances. In each round every cluster
   finds its most similar linked neighbour, all mutual best pairs merge in parallel, and links between the merged clusters become one. This
   stops when no link reaches the threshold: two crowds joined by a thin bridge stay two, as their points are unlike on average. Rounds run in
   one task for each category, over its cells.
5. A group has at least ``LEAST_GROUP`` points, more than chance puts into its cells. Points get the group of their cell, or of the
   nearest linked cell that touches theirs if their own is nearly empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.common import BROADCAST_ROWS, checked_broadcast, cut, heavy_keys, salted_join

#: Clusters are merged down to this similarity. 1 is the same place, 0 a root mean square distance of ``REACH`` scales.
THRESHOLD = 0.4
REACH = 8.0
#: Cells that are linked lie at most so many cells apart in each axis.
STEPS = 2
#: A linked cell has so many points in its neighbourhood, and the odds that chance put them there at the background's density are below exp(-CELL_ODDS).
LEAST = 3
CELL_ODDS = 7.0
#: A group has so many points, and the odds that chance made it anywhere in the category's space are below exp(-GROUP_ODDS).
LEAST_GROUP = 5
GROUP_ODDS = 4.6
#: Clipping of the background ends at the latest after so many rounds; it shrinks in each.
CLIPS = 50
TYPICAL = 3


@dataclass(frozen=True)
class Axis:
    """A number of a record. ``scale``: a distance that counts as one. ``kind``: plain, ratio or circle (of ``length``)."""

    column: str
    scale: float
    kind: str = "plain"
    length: float = 0.0

    def value(self) -> Column:
        c = F.col(self.column).cast("double")
        return F.log(c) if self.kind == "ratio" else c

    def count(self) -> int:
        """Cells of a circle; 0 for axes that do not close."""
        return int(round(self.length / self.scale)) if self.kind == "circle" else 0

    def cell(self, value: Column) -> Column:
        cell = F.floor(value / self.scale)
        return F.least(F.lit(self.count() - 1), F.greatest(F.lit(0), cell)).cast("long") if self.kind == "circle" else cell.cast("long")

    def places(self, value: Column) -> list[Column]:
        """Coordinates in scales in which distances are straight: a circle has two, on which near points are as far apart as along it."""
        if self.kind != "circle":
            return [value / self.scale]
        turn, radius = value * (2 * np.pi / self.length), self.length / self.scale / (2 * np.pi)
        return [F.cos(turn) * radius, F.sin(turn) * radius]


def merge_rounds(n: np.ndarray, mean: np.ndarray, spread: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, reach: float = REACH) -> np.ndarray:
    """Average linkage on a sparse graph: cluster number of each node, the smallest of its nodes.

    Nodes hold ``n`` points with a ``mean`` place and a ``spread`` (mean squared distance from it); ``a``-``b`` (a < b, no doubles) are linked.
    Each round merges all mutual best pairs; among equally similar neighbours the one with the smaller number is the best.
    """
    size = len(n)
    label = np.arange(size)
    n, mean, spread = n.astype(np.float64), mean.astype(np.float64).copy(), spread.astype(np.float64).copy()
    similarity = lambda i, j: 1 - (((mean[i] - mean[j]) ** 2).sum(1) + spread[i] + spread[j]) / reach**2
    s = similarity(a, b)
    while len(a):
        ok = s >= threshold  # clusters that are unlike now may become alike when one of them grows
        if not ok.any():
            break
        u, v, m = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]]), np.tile(s[ok], 2)
        order = np.lexsort((v, -m, u))
        u, v = u[order], v[order]
        first = np.r_[True, u[1:] != u[:-1]]
        best = np.full(size, -1)
        best[u[first]] = v[first]
        left = np.flatnonzero((best >= 0) & (best[best] == np.arange(size)))
        left = left[left < best[left]]
        right = best[left]
        share = n[right] / (n[left] + n[right])
        step = mean[right] - mean[left]
        spread[left] += share * (spread[right] - spread[left]) + share * (1 - share) * (step * step).sum(1)
        mean[left] += share[:, None] * step
        n[left] += n[right]
        target = np.arange(size)
        target[right] = left
        label = target[label]
        a, b = target[a], target[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        key = np.unique(a[a != b] * size + b[a != b])
        a, b = key // size, key % size
        s = similarity(a, b)
    return label


def surprise(count: np.ndarray, expected: np.ndarray | float) -> np.ndarray:
    """A lower bound of the negative logarithm of the odds that chance puts ``count`` or more points where ``expected`` are (Chernoff)."""
    count, expected = np.broadcast_arrays(np.asarray(count, np.float64), np.asarray(expected, np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = count * np.log(count / expected) - count + expected
    return np.where(count <= expected, 0.0, np.where(expected <= 0, np.inf, out))


class Cells:
    """The occupied cells of a category, and which of them are near each other."""

    def __init__(self, at: np.ndarray, axes: tuple[Axis, ...]):
        self.at, self.axes = at, axes
        self.values = [np.unique(at[:, i]) for i in range(len(axes))]
        self.own = self._key(at)[0]
        assert (np.diff(self.own) > 0).all(), "cells are sorted"

    def _key(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number of each place, in the places' order, and whether every coordinate occurs."""
        key, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for i, values in enumerate(self.values):
            k = np.minimum(np.searchsorted(values, at[:, i]), len(values) - 1)
            known &= values[k] == at[:, i]
            key = key * len(values) + k
        return key, known

    def moved(self, index: np.ndarray, step: tuple[int, ...]) -> np.ndarray:
        to = self.at[index] + np.array(step)
        for i, axis in enumerate(self.axes):
            if axis.kind == "circle":
                to[:, i] %= axis.count()
        return to

    def pairs(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of cells and of occupied ones up to ``steps`` away, for each direction; on a small circle a pair may come twice."""
        every = np.arange(len(self.at))
        for step in product(range(-steps, steps + 1), repeat=len(self.axes)):
            if any(step):
                key, known = self._key(self.moved(every, step))
                found = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
                hit = known & (self.own[found] == key) & (found != every)
                yield every[hit], found[hit]

    def touched(self, index: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """For each mark 0, 1 ... the number of cells, occupied or not, that its cells (``index``) are or touch."""
        around = [np.column_stack([mark, self.moved(index, step)]) for step in product((-1, 0, 1), repeat=len(self.axes))]
        out = np.zeros(int(mark.max(initial=-1)) + 1, np.int64)
        if len(index):
            np.add.at(out, np.unique(np.concatenate(around), axis=0)[:, 0], 1)
        return out

    def volume(self) -> float:
        """Cells of the category's space: along each axis those that occur and those beside them."""
        out = 1.0
        for axis, values in zip(self.axes, self.values):
            beside = np.unique(np.concatenate([values - 1, values, values + 1]))
            out *= min(len(beside), axis.count()) if axis.kind == "circle" else len(beside)
        return out


def crowded(cells: Cells, n: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Which cells hold, alone or with their neighbourhood (``near``), more points than chance would put there; and the background's points for each cell."""
    around = n.astype(np.int64).copy()
    for i, j in near:
        np.add.at(around, i, n[j])
    block, space, total = 3 ** len(cells.axes), cells.volume(), int(n.sum())
    elsewhere = (total - around) / max(space - block, 1.0)  # a lone crowd is no background of its own
    density, dense = total / space, np.zeros(len(n), bool)
    for _ in range(CLIPS):
        chance = np.minimum(density, elsewhere)
        odds = np.maximum(surprise(around, block * chance), np.where(n >= LEAST, surprise(n, chance), 0.0))
        now = dense | ((around >= LEAST) & (odds >= CELL_ODDS))
        if (now == dense).all():
            break
        dense = now
        taken = dense.copy()
        for i, j in near:
            taken[i[dense[j]]] = True
        left = space - cells.touched(np.flatnonzero(dense), np.zeros(int(dense.sum()), np.int64)).sum()
        density = min(density, n[~taken].sum() / max(left, 1.0))
    return dense, density


def link_cells(cells: pd.DataFrame, axes: tuple[Axis, ...], threshold: float, linkage=merge_rounds) -> pd.DataFrame:
    """Groups of one category's cells: cell columns ``c0``.., ``g`` (a number within the category).

    ``cells`` has ``c0``.., the count ``n``, and in straight coordinates the means ``m0``.. and ``v``, the sum of their variances. Cells
    without a group are left out.
    """
    names = [f"c{i}" for i in range(len(axes))]
    cells = cells.sort_values(names)
    at = cells[names].to_numpy(np.int64)
    mean = cells[[c for c in cells.columns if c.startswith("m")]].to_numpy(np.float64)
    n, spread = cells["n"].to_numpy(np.int64), cells["v"].to_numpy(np.float64)
    grid = Cells(at, axes)
    near = list(grid.pairs(1))
    dense, density = crowded(grid, n, near)
    links = [np.zeros(0, np.int64)]
    for i, j in grid.pairs(STEPS):
        keep = (i < j) & dense[i] & dense[j]
        links.append(i[keep] * len(n) + j[keep])
    link = np.unique(np.concatenate(links))
    label = linkage(n, mean, spread, link // len(n), link % len(n), threshold)
    own = np.flatnonzero(dense)
    _, mark = np.unique(label[own], return_inverse=True)
    size = np.bincount(mark, n[own])
    odds = surprise(size, density * grid.touched(own, mark))
    good = (size >= LEAST_GROUP) & (odds >= GROUP_ODDS + np.log(grid.volume()))
    group = np.full(len(n), -1)
    group[own] = np.where(good[mark], label[own], -1)
    # nearly empty cells at the rim of a group belong to the nearest cell of it that they touch
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in near)]) for k in (0, 1))
    rim = ~dense[a] & (group[b] >= 0)
    ra, rb = a[rim], b[rim]
    order = np.lexsort((rb, ((mean[ra] - mean[rb]) ** 2).sum(1), ra))
    ra, rb = ra[order], rb[order]
    first = np.r_[True, ra[1:] != ra[:-1]] if len(ra) else np.zeros(0, bool)
    group[ra[first]] = group[rb[first]]
    out = pd.DataFrame(at, columns=names).assign(g=group)
    return out[out["g"] >= 0]


def placed_points(df: DataFrame, id_col: str, category: str, axes: tuple[Axis, ...], threshold: float = THRESHOLD) -> DataFrame:
    """Records in a group: ``_id``, ``_cat``, ``g`` (a number within the category) and the axes' values ``x0``..; the rest has no row."""
    k = range(len(axes))
    usable = F.col(category).isNotNull()
    for axis in axes:
        c = F.col(axis.column)
        usable &= c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        if axis.kind == "ratio":
            usable &= c > 0
    points = df.where(usable).select(F.col(id_col).alias("_id"), F.col(category).alias("_cat"), *[axis.value().alias(f"x{i}") for i, axis in enumerate(axes)])
    points = points.withColumns({f"c{i}": axis.cell(F.col(f"x{i}")) for i, axis in enumerate(axes)})
    cell_columns = [f"c{i}" for i in k]
    places = [p for i, axis in enumerate(axes) for p in axis.places(F.col(f"x{i}"))]
    spread = sum((F.var_pop(p) for p in places), F.lit(0.0))
    cells = points.groupBy("_cat", *cell_columns).agg(F.count("*").alias("n"), spread.alias("v"), *[F.avg(p).alias(f"m{i}") for i, p in enumerate(places)])

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return link_cells(pdf, axes, threshold).assign(_cat=key[0])[["_cat", *cell_columns, "g"]]

    fields = ", ".join(f"{c} long" for c in cell_columns)
    kind = df.schema[category].dataType.simpleString()
    groups = cut(cells.groupBy("_cat").applyInPandas(linked, f"_cat {kind}, {fields}, g long"))
    keys = ["_cat", *cell_columns]
    if groups.count() <= BROADCAST_ROWS:
        joined = points.join(F.broadcast(groups), keys)
    else:  # a cell may hold a large share of all points
        cell = F.struct(*keys).alias("_cell")
        spread_points = points.select("*", cell)
        joined = salted_join(spread_points, groups.select(cell, "g"), ["_cell"], heavy_keys(spread_points, "_cell"), F.col("_id")).drop("_cell")
    return joined.drop(*cell_columns)


def members(df: DataFrame, id_col: str, category: str, axes: tuple[Axis, ...], threshold: float = THRESHOLD) -> DataFrame:
    """Only which group a record is in: ``id_col`` and ``group_id``, a struct of the category and a number."""
    out = placed_points(df, id_col, category, axes, threshold)
    return out.select(F.col("_id").alias(id_col), F.struct(F.col("_cat").alias("category"), F.col("g").alias("number")).alias("group_id"))


def cluster(
    df: DataFrame, id_col: str, category: str, axes: tuple[Axis, ...], threshold: float = THRESHOLD, typical: int = TYPICAL
) -> DataFrame:
    """For each record in a group: ``id_col``, ``category``, ``group_id``, ``group_size``, ``typical_members`` (an array of ids).

    ``df`` has one row for each id; records with a null category or a null, NaN or infinite number are in no group, nor are isolated
    ones. ``group_id`` is the smallest id of the group. The most typical members are those nearest to the group's mean place,
    ties by id.
    """
    member = placed_points(df, id_col, category, axes, threshold)

    # a group's mean place: on a circle by the mean direction
    parts = [F.count("*").alias("group_size"), F.min("_id").alias("group_id")]
    for i, axis in enumerate(axes):
        if axis.kind == "circle":
            turn = F.col(f"x{i}") * (2 * np.pi / axis.length)
            parts += [F.avg(F.cos(turn)).alias(f"cos{i}"), F.avg(F.sin(turn)).alias(f"sin{i}")]
        else:
            parts.append(F.avg(f"x{i}").alias(f"mean{i}"))
    summary = checked_broadcast(member.groupBy("_cat", "g").agg(*parts))  # a row for each group
    placed = member.join(summary, ["_cat", "g"])
    far = F.lit(0.0)
    for i, axis in enumerate(axes):
        if axis.kind == "circle":
            centre = F.pmod(F.atan2(f"sin{i}", f"cos{i}") * (axis.length / (2 * np.pi)), F.lit(axis.length))
            d = F.abs(F.col(f"x{i}") - centre)
            d = F.least(d, axis.length - d)
        else:
            d = F.col(f"x{i}") - F.col(f"mean{i}")
        far = far + (d / axis.scale) * (d / axis.scale)
    near = Window.partitionBy("_cat", "g").orderBy(F.round(far, 9), "_id")  # limited to the first rows before the shuffle
    top = placed.select("_cat", "g", "_id", F.row_number().over(near).alias("_pos")).where(F.col("_pos") <= typical)
    shown = top.groupBy("_cat", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda s: s["_id"]).alias("typical_members"))
    summary = summary.select("_cat", "g", "group_id", "group_size").join(shown, ["_cat", "g"])
    return member.select("_id", "_cat", "g").join(F.broadcast(summary), ["_cat", "g"]).select(
        F.col("_id").alias(id_col), F.col("_cat").alias(category), "group_id", "group_size", "typical_members"
    )


def same_group_pairs(groups: DataFrame, pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """The distinct listed pairs (smaller id first) whose two records are in the same group; a record with itself is no pair."""
    g = groups.select(F.col(id_col).alias("_id"), "group_id")
    listed = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()
    first = listed.join(g.withColumnRenamed("group_id", "_ga"), F.col(a) == F.col("_id")).drop("_id")
    both = first.join(g.withColumnRenamed("group_id", "_gb"), F.col(b) == F.col("_id"))
    return both.where(F.col("_ga") == F.col("_gb")).select(a, b)
