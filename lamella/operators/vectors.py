"""Neighbours and scores over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reference vectors that a task holds at once, and queries that are searched for together if there are more.
BLOCK = 50_000
QUERY_BLOCK = 20_000


def nearest_reference(queries: DataFrame, reference: DataFrame, id_col: str, vector: str, k: int = 5, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """For each query vector the ``k`` nearest reference vectors by cosine distance, exact; a row is not its own neighbour.

    Columns: ``id_col``, ``rank``, ``neighbor``, ``cosine_distance`` rounded to ``digits``; ties by id. Zero vectors and nulls take no part. Up to
    ``block`` reference vectors are broadcast. More are spread over blocks by a hash of their id, as queries are, and each task
    compares a block of queries with a block of the reference; each yields k candidates for each query. That is all there is to
    compare, in blocks; for the most similar vectors of very many there are approximate ways.
    """
    spark = queries.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, neighbor {kind}, far double"
    queries = queries.where(F.col(vector).isNotNull()).select(id_col, vector)
    reference = reference.where(F.col(vector).isNotNull()).select(id_col, vector)
    few = reference.limit(block + 1).toPandas()

    def unit_rows(ids, vectors) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(vectors, np.float64).reshape(len(ids), len(vectors[0]) if len(vectors) else 0)
        size = np.linalg.norm(x, axis=1)
        return np.array(ids)[size > 0], x[size > 0] / size[size > 0, None]

    def search(own: np.ndarray, q: np.ndarray, names: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(own) if len(names) else 0, 512):
            far = np.round(np.maximum(1 - q[a : a + 512] @ unit.T, 0.0), digits)
            far[own[a : a + 512, None] == names[None, :]] = np.inf
            width = min(k, len(names))
            # the k nearest of a row and all that tie with the last of them
            edge = np.partition(far, width - 1, axis=1)[:, width - 1 : width]
            at, to = np.nonzero((far <= edge) & np.isfinite(far))
            order = np.lexsort((names[to], far[at, to], at))
            at, to = at[order], to[order]
            count = np.bincount(at, minlength=len(far))
            keep = np.arange(len(at)) - (np.cumsum(count) - count)[at] < k
            at, to = at[keep], to[keep]
            yield pa.RecordBatch.from_arrays([pa.array(own[a + at]), pa.array(names[to]), pa.array(far[at, to])], [id_col, "neighbor", "far"])

    if len(few) <= block:
        shared = spark.sparkContext.broadcast(unit_rows(few[id_col].tolist(), few[vector].tolist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from search(*unit_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist()), *shared.value)

        found = queries.mapInArrow(run, out)
    else:
        b, c = (max(1, -(-df.count() // size)) for df, size in ((reference, block), (queries, QUERY_BLOCK)))
        part = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = queries.select("*", part(c).alias("_q"), every(b).alias("_r"))
        known = reference.select("*", part(b).alias("_r"), every(c).alias("_q"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            sides = [unit_rows(t.column(id_col).to_pylist(), t.column(vector).to_pylist()) for t in (left, right)]
            schema = pa.schema([left.schema.field(id_col), left.schema.field(id_col).with_name("neighbor"), ("far", pa.float64())])
            return pa.Table.from_batches([x.cast(schema) for x in search(*sides[0], *sides[1])], schema)

        found = asked.groupBy("_q", "_r").cogroup(known.groupBy("_q", "_r")).applyInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("far", "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(id_col, "rank", "neighbor", F.col("far").alias("cosine_distance"))


def min_max(df: DataFrame, value: Column, name: str, epsilon: float = 1e-12) -> DataFrame:
    """``df`` with ``value`` mapped to 0..1 by the smallest and largest of the corpus; one aggregate row is joined, not a global window."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon)).drop("_lo", "_hi")
