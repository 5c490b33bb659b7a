"""Percentiles of very large columns with bounded rank error, by mergeable relative-rank compactors.

A sketch is a stack of compactors. A compactor keeps a buffer of values; when the buffer is full it protects the values at
the accurate end of the order and halves some of the rest, handing every other one of them to the next level, where
each stands for twice as many. As the protected half never loses anything while it stays at the accurate end, the error of a
rank is a small multiple of the distance of that rank from the accurate end: very small at extreme percentiles. A sketch for
low percentiles protects the smallest values, one for high percentiles the largest.

Sketches of partitions, days or files merge level by level into the sketch of the union with the same bound, so
results can be stored for each day and combined later. The standard error of a rank is about 0.13 / ``SECTION`` of its distance from the accurate
end (0.2 % of it, as published for this scheme), whatever the number of values and of merges; smaller sketches with fewer values are exact. A sketch has about ``SECTION`` x 6 values for each level and
a level for each doubling of the count; it does not grow with a hot group, and only sketches are shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Values in a section; the relative error falls in proportion to it.
SECTION = 64
#: Sketches merged by one task of the first merging step.
FAN_IN = 64


class RankSketch:
    """A relative-rank sketch of floats. ``high``: accurate for the largest values, else for the smallest."""

    def __init__(self, high: bool, section: int = SECTION, seed: int = 0):
        self.high, self.section, self.n = high, section, 0
        self.levels: list[np.ndarray] = []
        self.state: list[int] = []
        self.sections: list[int] = []
        self.seed, self.rng = seed, None

    def _grow(self, levels: int) -> None:
        while len(self.levels) < levels:
            self.levels.append(np.zeros(0))
            self.state.append(0)
            self.sections.append(3)

    def _size(self, level: int) -> int:
        """Values in a section of a level: fewer, as the level has more of them."""
        doublings = int(np.log2(self.sections[level] / 3))
        return max(4, int(self.section / 2 ** (doublings / 2)) // 2 * 2)

    def capacity(self, level: int) -> int:
        return 2 * self.sections[level] * self._size(level)

    def update(self, values: np.ndarray) -> None:
        """Add finite values."""
        self._grow(1)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.n += len(values)
        self._compress()

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.capacity(level):
                self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        # the state's trailing ones say how many sections take part: the last one always, earlier ones ever more seldom
        ones, s = 1, self.state[level]
        while s & 1:
            ones, s = ones + 1, s >> 1
        ones = min(ones, self.sections[level])
        protected = self.capacity(level) // 2 + (self.sections[level] - ones) * self._size(level)
        buffer = np.sort(self.levels[level])
        if self.high:
            buffer = buffer[::-1]
        protected += (len(buffer) - protected) % 2
        keep, rest = buffer[:protected], buffer[protected:]
        if self.rng is None:
            self.rng = np.random.default_rng(self.seed)
        self._grow(level + 2)
        self.levels[level] = keep.copy()
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], rest[int(self.rng.integers(2)) :: 2]])
        self.state[level] += 1
        if self.state[level] >= 2 ** (self.sections[level] - 1):
            self.sections[level] *= 2

    def merge(self, other: RankSketch) -> None:
        """Take in another sketch of the same kind."""
        self._grow(len(other.levels))
        for i, values in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], values])
            self.state[i] |= other.state[i]
            self.sections[i] = max(self.sections[i], other.sections[i])
        self.n += other.n
        self._compress()

    def quantile(self, share: float) -> float | None:
        """The smallest value with at least ``share`` of all values at or below it; None if there are none."""
        if not self.n:
            return None
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << i, np.int64) for i, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        # weights add up to n as pairs are halved only: rounding to even counts keeps every unit
        rank = max(1, int(np.ceil(share * self.n - 1e-9)))
        if self.high:  # count from the accurate end
            below = self.n - np.cumsum(weights[::-1])[::-1]  # values before each
            return float(values[max(0, int(np.searchsorted(below, rank - 1, side="right")) - 1)])
        return float(values[min(len(values) - 1, int(np.searchsorted(np.cumsum(weights), rank)))])

    def to_bytes(self) -> bytes:
        head = struct.pack("<?IqI", self.high, self.section, self.n, len(self.levels))
        parts = [struct.pack("<qII", s, k, len(v)) for s, k, v in zip(self.state, self.sections, self.levels)]
        return head + b"".join(parts) + np.concatenate([np.zeros(0), *self.levels]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        high, section, n, levels = struct.unpack_from("<?IqI", data)
        out = cls(high, section, seed=n & 0x7FFFFFFF)
        out.n = n
        at = struct.calcsize("<?IqI")
        sizes = []
        for _ in range(levels):
            state, sections, size = struct.unpack_from("<qII", data, at)
            at += struct.calcsize("<qII")
            out.state.append(state)
            out.sections.append(sections)
            sizes.append(size)
        values = np.frombuffer(data, np.float64, offset=at)
        ends = np.cumsum(sizes).astype(int)
        out.levels = [values[e - s : e].copy() for s, e in zip(sizes, ends)]
        return out


def sketch(df: DataFrame, by: list[str], value: str, section: int = SECTION) -> DataFrame:
    """Sketches of ``value`` by group: columns ``by``, ``high`` (which end is accurate), ``n`` and ``sketch``.

    Null, NaN and infinite values are left out; a null in a grouping column is a group. Partitions are sketched where
    they are, then sketches are merged in two steps, so no task sees more than a share of a hot group's.
    """
    schema = df.select(*by).schema.simpleString()[len("struct<") : -1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[RankSketch]] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            pdf = pdf[np.isfinite(pdf[value].to_numpy(np.float64, na_value=np.nan))]
            for key, part in pdf.groupby(by, dropna=False, sort=True)[value]:
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                pair = kept.setdefault(key, [RankSketch(h, section, seed=len(kept)) for h in (False, True)])
                for s in pair:
                    s.update(part.to_numpy(np.float64))
        rows = [(*key, s.high, s.n, s.to_bytes()) for key, pair in kept.items() for s in pair]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[*by, "high", "n", "sketch"]), preserve_index=False)

    data = df.select(*by, F.col(value).cast("double").alias(value))
    out = f"{schema},high boolean,n long,sketch binary"
    parts = data.mapInArrow(local, out)
    return merge_sketches(parts.withColumn("_part", F.spark_partition_id()), by)


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches (of partitions, days ...) into one for each group of ``by``.

    With a column ``_part`` the merge has a first step in which each task merges about ``FAN_IN`` of a group's sketches.
    """
    def merged(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sketches arrive sorted by ``keys``; only the group at hand is held."""
            current, total, rows = None, None, []
            for batch in batches:
                table = batch.to_pydict()
                for i, data in enumerate(table["sketch"]):
                    key = tuple(table[c][i] for c in keys)
                    if key != current:
                        if total is not None:
                            rows.append((*current, total.n, total.to_bytes()))
                        current, total = key, RankSketch.from_bytes(data)
                    else:
                        total.merge(RankSketch.from_bytes(data))
                if rows:
                    yield batch_of(rows)
                    rows = []
            if total is not None:
                yield batch_of([(*current, total.n, total.to_bytes())])

        names = [*keys, "n", "sketch"]
        types = {f.name: to_arrow_type(f.dataType) for f in parts.schema.fields} | {"_part": pa.int64()}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*rows))], names)

        return run

    def step(df: DataFrame, keys: list[str]) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
        sorted_parts = df.select(*keys, "n", "sketch").repartition(*keys).sortWithinPartitions(*keys, F.desc("n"), "sketch")
        return sorted_parts.mapInArrow(merged(keys), ", ".join([*fields, "n long", "sketch binary"]))

    keys = [*by, "high"]
    if "_part" in parts.columns:
        parts = step(parts.withColumn("_part", F.floor(F.col("_part") / FAN_IN)), [*keys, "_part"])
    return step(parts, keys)


def percentiles(sketches: DataFrame, by: list[str], points: list[float]) -> DataFrame:
    """Percentiles (0 to 100) from sketches: ``by``, ``n``, ``percentile``, ``value``.

    Points up to 50 are answered by the sketch that is accurate for low values, the others by the other one.
    """
    fields = sketches.select(*by).schema.simpleString()[len("struct<") : -1]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, high, n, data in zip(pdf[by].itertuples(index=False, name=None), pdf["high"], pdf["n"], pdf["sketch"]):
                own = RankSketch.from_bytes(data)
                rows += [(*key, n, float(p), own.quantile(p / 100)) for p in points if (p > 50) == high]
            yield pd.DataFrame(rows, columns=[*by, "n", "percentile", "value"])

    return sketches.mapInPandas(ask, f"{fields + ',' if by else ''}n long,percentile double,value double")
