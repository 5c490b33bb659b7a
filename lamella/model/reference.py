"""Scoring against a small reference corpus: robust scaling, principal components, isolation forest, cosine neighbours, percentile."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.common import cut, heavy_keys, salted_join
from lamella.operators.quantiles import exact_percentiles

#: A model is fitted on at most so many rows of its reference corpus; of a larger corpus on those with the smallest hashes of their ids.
MAX_REFERENCE = 50_000
#: Distances to the reference that a task holds at once.
DISTANCES = 1 << 22


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's median and interquartile range, exact with linear interpolation; a zero range counts as 1, and a column
    without finite numbers has nulls."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    quartiles = exact_percentiles(long.select("x.c", "x.v"), ["c"], F.col("v"), [0.25, 0.5, 0.75], "q")
    q = lambda c, i: F.max(F.when(F.col("c") == c, F.col("q")[i]))
    out = []
    for c in columns:
        span = q(c, 2) - q(c, 0)
        out += [q(c, 1).alias(f"{c}__median"), F.when(span == 0, 1.0).otherwise(span).alias(f"{c}__range")]
    return quartiles.agg(*out)


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns scaled: less the median, over the interquartile range."""
    p = F.broadcast(robust_parameters(df, columns))  # one row
    scaled = [((F.col(c) - F.col(f"{c}__median")) / F.col(f"{c}__range")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.crossJoin(p).select(*scaled)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """An isolation forest (Liu, Ting and Zhou 2008) as flat arrays: for each tree and node the feature (-1: leaf), threshold, left child, and depth."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 300, sample: int = 256, seed: int = 42) -> Forest:
        rng = np.random.default_rng(seed)
        m = min(sample, len(x))
        limit = int(np.ceil(np.log2(max(m, 2))))
        size = 2 ** (limit + 1) - 1
        feature = np.full((trees, size), -1, np.int32)
        threshold, path = np.zeros((trees, size)), np.zeros((trees, size))
        left = np.zeros((trees, size), np.int32)
        for t in range(trees):
            rows = rng.choice(len(x), m, replace=False)
            stack, used = [(0, rows, 0)], 1
            while stack:
                node, own, depth = stack.pop()
                part = x[own]
                spans = np.flatnonzero(part.max(0) > part.min(0)) if len(own) > 1 else []
                if depth >= limit or not len(spans):
                    path[t, node] = depth + float(average_path(len(own)))
                    continue
                f = int(rng.choice(spans))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                below = part[:, f] <= cut
                feature[t, node], threshold[t, node], left[t, node] = f, cut, used
                stack += [(used, own[below], depth + 1), (used + 1, own[~below], depth + 1)]
                used += 2
        return cls(feature, threshold, left, path, float(average_path(m)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for points that are easier to isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, path in zip(self.feature, self.threshold, self.left, self.path):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class ReferenceModel:
    """What is fitted on the reference corpus, and how new feature vectors are scored with it."""

    columns: list[str]
    names: list[str]
    median: np.ndarray
    span: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    corpus: np.ndarray
    forest: Forest
    raw: np.ndarray
    k: int

    @classmethod
    def fit(cls, reference: DataFrame, id_col: str, columns: list[str], components: int = 8, trees: int = 300, k: int = 5, seed: int = 42, bound: int = MAX_REFERENCE) -> ReferenceModel:
        """Fit on a reference corpus; numbers that are not finite count as 0. Of more than ``bound`` rows those with the smallest hashes of
        their ids are taken, wherever they lie. Percentiles and neighbours are then those among the rows taken."""
        rows = reference.select(id_col, *columns).orderBy(F.xxhash64(id_col), id_col, *columns).limit(bound).toPandas().sort_values(id_col)
        if len(rows) < 3:
            raise ValueError("a reference corpus has at least three rows")
        x = cleaned(rows[columns])
        q1, median, q3 = np.percentile(x, [25, 50, 75], axis=0)
        span = np.where(q3 > q1, q3 - q1, 1.0)
        z = (x - median) / span
        mean = z.mean(0)
        _, s, axes = np.linalg.svd(z - mean, full_matrices=False)
        n = max(1, min(components, len(x) - 2, x.shape[1]))
        total = max(float((s * s).sum()), 1e-300)
        corpus = (z - mean) @ axes[:n].T
        forest = Forest.fit(corpus, trees, seed=seed)
        return cls(columns, rows[id_col].tolist(), median, span, mean, axes[:n], (s * s / total)[:n], corpus, forest, forest.score(corpus), min(k, len(x)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the fitted model as one row: its arrays in a portable binary form, its names as text."""
        parts = {f"forest_{n}": getattr(self.forest, n) for n in ("feature", "threshold", "left", "path", "norm")}
        parts |= {n: getattr(self, n) for n in ("median", "span", "mean", "axes", "explained", "corpus", "raw")}
        out = io.BytesIO()
        np.savez(out, **parts)
        row = (json.dumps(dict(columns=self.columns, names=self.names, k=self.k)), bytearray(out.getvalue()))
        spark.createDataFrame([row], "head string, arrays binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ReferenceModel:
        """A stored model; raises if there is none or more than one."""
        rows = spark.read.schema("head string, arrays binary").parquet(path).limit(2).collect()
        if len(rows) != 1:
            raise ValueError("one stored model was expected")
        head = json.loads(rows[0]["head"])
        with np.load(io.BytesIO(bytes(rows[0]["arrays"])), allow_pickle=False) as z:
            parts = {n: z[n] for n in z.files}
        forest = Forest(*[parts.pop(f"forest_{n}") for n in ("feature", "threshold", "left", "path")], float(parts.pop("forest_norm")))
        return cls(forest=forest, **head, **parts)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.median) / self.span - self.mean) @ self.axes.T

    def analyze(self, x: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Percentiles of rows among the reference (share of it that is at most as unusual), and their nearest reference rows."""
        z = self.project(x)
        raw = np.sort(self.raw)
        percentile = np.round(np.searchsorted(raw, self.forest.score(z), side="right") / len(raw), 6)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        lists: list[list[dict]] = []
        corpus, rows = unit(self.corpus).T, max(1, DISTANCES // max(1, len(self.corpus)))
        for a in range(0, len(z), rows):
            far = np.round(1 - unit(z[a : a + rows]) @ corpus, 12)
            # the k nearest and all that tie with the last of them; equally near ones in the reference's order
            edge = np.partition(far, self.k - 1, axis=1)[:, self.k - 1]
            for own, last in zip(far, edge):
                close = np.flatnonzero(own <= last)
                close = close[np.argsort(own[close], kind="stable")][: self.k]
                lists.append([dict(plate_id=self.names[j], cosine_distance=round(max(0.0, float(own[j])), 4)) for j in close])
        return percentile, lists

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``reference_anomaly_percentile`` and ``nearest_reference_plates``, scored in batches beside the data."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # at most MAX_REFERENCE rows of a few components

        @F.pandas_udf("reference_anomaly_percentile double, nearest_reference_plates array<struct<plate_id:string,cosine_distance:double>>")
        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for pdf in batches:
                percentile, lists = model.analyze(cleaned(pdf))
                yield pd.DataFrame({"reference_anomaly_percentile": percentile, "nearest_reference_plates": lists})

        vector = F.struct(*[F.col(c).try_cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in self.columns])
        return df.withColumn("_scored", scored(vector)).select(*df.columns, "_scored.*")


def cleaned(pdf: pd.DataFrame) -> np.ndarray:
    """Numbers of a frame; those that are not finite as 0."""
    return np.nan_to_num(pdf.to_numpy(np.float64, na_value=np.nan), nan=0.0, posinf=0.0, neginf=0.0)


def empirical_percentile(df: DataFrame, value: Column, reference: DataFrame, reference_value: Column, name: str) -> DataFrame:
    """``df`` with the share of reference values at or below ``value``; null if ``value`` is null or NaN, or there are no reference values.

    Reference values are counted by value first. Up to ``MAX_REFERENCE`` different ones are an array that is broadcast, so a row needs a binary
    search; of more, values are ranked where they are: all different values are sorted by range, counted within their partition, and rows look up
    the rank of theirs, those of hot values spread over tasks. Nothing but a count for each partition reaches the driver.
    """
    v = reference_value.cast("double")
    counted = reference.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count("*").alias("c"))
    few = counted.limit(MAX_REFERENCE + 1).collect()
    if len(few) <= MAX_REFERENCE:
        few.sort()
        at = np.array([r[0] for r in few], np.float64)
        upto = np.concatenate([[0], np.cumsum([r[1] for r in few])]).astype(np.float64)
        shared = df.sparkSession.sparkContext.broadcast((at, upto))

        @F.pandas_udf("double")
        def share(v: pd.Series) -> pd.Series:
            at, upto = shared.value
            out = upto[np.searchsorted(at, v.to_numpy(np.float64, na_value=np.nan), side="right")] / max(upto[-1], 1)
            return pd.Series(np.where(v.isna() | (len(at) == 0), np.nan, out))

        return df.withColumn(name, F.nanvl(share(value.cast("double")), F.lit(None).cast("double")))
    asked = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    both = counted.unionByName(asked.withColumn("c", F.lit(0).cast("long"))).groupBy("v").agg(F.sum("c").alias("c"))
    placed = cut(both.repartitionByRange("v")).withColumn("part", F.spark_partition_id())
    sums = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("c")).collect())  # one for each partition
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "part int, before long"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = placed.withColumn("upto", upto).join(offsets, "part").select(F.col("v").alias("_v"), ((F.col("upto") + F.col("before")) / total).alias(name))
    rows = df.withColumn("_v", value.cast("double"))
    spread = F.struct(*df.columns)
    return salted_join(rows, ranks, ["_v"], heavy_keys(rows, "_v"), spread, how="left").select(*df.columns, name)
