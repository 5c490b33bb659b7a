"""Most similar vectors for every vector, by collision-counting hashing.

Every vector is hashed by ``ARRAYS`` single random projections. The values of a projection form a sorted array. A query opens a window
around its own value in each array, both ends found by binary search, and counts over all arrays how often each vector lies
in its windows. Vectors that collide in at least ``COLLISIONS`` arrays are verified by their similarity. If the k-th best is not as similar as
vectors that such windows hold (nearly) for certain, the windows expand around the same centres (virtual rehashing: nothing is hashed again) and
what has newly collided often enough is verified, if need be until they cover the arrays.

Beside a sorted array stand the sets of vectors up to some ``MARKS`` evenly spaced positions, as bits. A window is the difference of the sets at its
two ends (rounded outwards to a mark), however wide it is, and collisions are counted for 64 vectors at once by adding up
bits; a block's vectors are never compared with each other in pairs.

Arrays over the whole collection would put a fixed share of it into each window. So, as in the partitioned form of the scheme,
the collection is first divided into blocks around pivot vectors (centres of a bounded sample); each vector enters the blocks of its
``copies`` nearest pivots and the arrays are kept for each block. Two vectors meet if they share a block. Away from the block of its
nearest pivot a query stops once ``ENOUGH`` + k were verified.

Cost: each vector is shuffled ``copies`` times at two bytes a component. As long as the number of pivots grows with the rows, blocks keep their
size. Beyond ``MAX_PIVOTS`` they grow, and a block of more than ``SPLIT_ROWS`` is divided in the same way within its task, so that
the work stays in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.common import cut

K = 5
COPIES = 3
BLOCK_ROWS = 400
#: Bound on the pivots that are broadcast. They are the centres of a sample of at most 16 rows for each, after ``ROUNDS`` rounds of moving them.
MAX_PIVOTS = 16_384
ROUNDS = 2
#: Blocks of more rows than this are divided again within their task.
SPLIT_ROWS = 6_000
#: Blocks expected to hold more rows than this are worked on in pairs of tiles, so that no task needs more memory; no pair is lost.
TILE_ROWS = 100_000
#: A direction with more copies than this, and more than a 10,000th of all rows, is searched for once.
HEAVY_COPIES = 2_048
#: Arrays; 15 counts fit into four bits. Collisions that make a candidate.
ARRAYS = 15
COLLISIONS = 10
#: Half width of the first windows, in standard deviations of a projection of unit vectors, and the factor by which they expand.
FIRST_HALF = 0.5
WIDEN = 1.5
#: Vectors whose distance is the half width over this nearly always collide often enough.
CERTAIN = 1.6
#: Windows away from the nearest pivot's block expand no more once so many candidates (and k) were verified.
ENOUGH = 30
#: Positions of a sorted array at which the set of vectors before it is kept.
MARKS = 128
QUERY_ROWS = 512
#: Candidates that are verified at once, or those of one query if it has more.
CANDIDATES = 1 << 17


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are vectors of ``dim`` finite values, not all zero; and these, of length one."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    values = column.filter(pa.array(sized)).flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(values, np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    # very large and very small values overflow or vanish when squared
    odd = np.isfinite(x).all(1) & (x != 0).any(1) & ~good
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
        norm[odd] = np.sqrt(np.einsum("ij,ij->i", x[odd], x[odd]))
        good |= odd
    ok = sized.copy()
    ok[sized] = good
    return ok, x[good] / norm[good, None]


def quantise(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, each scaled to its own largest component."""
    return np.rint(unit * (32767.0 / np.abs(unit).max(1, keepdims=True))).astype(np.int16)


def binary_array(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


class Pivots:
    """Pivot vectors; beyond ``flat`` of them the nearest are looked up in two levels."""

    def __init__(self, vectors: np.ndarray, copies: int, flat: int = 2_048, probes: int = 8):
        self.vectors = vectors.astype(np.float32)
        self.copies = min(copies, len(vectors))
        self.top = None
        if len(vectors) > flat:
            self.top = self.vectors[:: int(np.sqrt(len(vectors)))]
            self.probes = min(probes, len(self.top))
            home = np.argmax(self.vectors @ self.top.T, 1)
            self.lists = [np.flatnonzero(home == i) for i in range(len(self.top))]

    @staticmethod
    def _best(s: np.ndarray, n: int) -> np.ndarray:
        out = np.argpartition(-s, n - 1, 1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        return np.take_along_axis(out, np.argsort(-np.take_along_axis(s, out, 1), 1, kind="stable"), 1)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """For each row the indexes of its nearest pivots, the nearest first."""
        unit = unit.astype(np.float32)
        if self.top is None:
            return self._best(unit @ self.vectors.T, self.copies)
        probed = self._best(unit @ self.top.T, self.probes)
        score = np.full((len(unit), self.copies), -np.inf, np.float32)
        out = np.zeros((len(unit), self.copies), np.int64)
        for g in np.unique(probed):
            rows, own = np.flatnonzero((probed == g).any(1)), self.lists[g]
            s = np.hstack([score[rows], unit[rows] @ self.vectors[own].T])
            ids = np.hstack([out[rows], np.tile(own, (len(rows), 1))])
            pick = np.argsort(-s, 1, kind="stable")[:, : self.copies]
            score[rows], out[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(ids, pick, 1)
        return out


def centred(sample: np.ndarray, pivots: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots moved to the middle of the sample's vectors that are nearest to them; those without any stay."""
    for _ in range(rounds):
        home = Pivots(pivots, 1).nearest(sample)[:, 0]
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        total = np.add.reduceat(sample[order], first)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        pivots = pivots.copy()
        pivots[used] = np.where(length > 0, total / np.where(length > 0, length, 1), pivots[used])
    return pivots


def added_up(sets: Iterator[np.ndarray]) -> list[np.ndarray]:
    """The number of sets that each bit is in, as binary digits, the lowest first."""
    digits, level = [], list(sets)
    while level:
        carried = []
        while len(level) > 2:
            a, b, c = level.pop(), level.pop(), level.pop()
            either = a ^ b
            carried.append((a & b) | (either & c))
            level.append(either ^ c)
        if len(level) == 2:
            a, b = level.pop(), level.pop()
            carried.append(a & b)
            level.append(a ^ b)
        digits.append(level[0])
        level = carried
    return digits


def at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """The bits whose number is at least ``least``."""
    more = np.zeros_like(digits[0])
    equal = ~more
    if least >> len(digits):
        return more
    for i in range(len(digits) - 1, -1, -1):
        if least >> i & 1:
            equal &= digits[i]
        else:
            more |= equal & digits[i]
    return more | equal


class SortedArrays:
    """The sorted values of each projection, and the sets of rows before evenly spaced positions."""

    def __init__(self, projected: np.ndarray):
        n, arrays = projected.shape
        self.step = max(8, -(-n // MARKS))
        marks = np.arange(0, n + self.step, self.step)
        order = np.argsort(projected, 0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)
        self.before = np.zeros((arrays, len(marks), -(-n // 64)), np.uint64)
        rank = np.empty(n, np.int64)
        for own, sets in zip(order.T, self.before):
            rank[own] = np.arange(n)
            packed = np.packbits(rank[None, :] < marks[:, None], axis=1, bitorder="little")
            sets.view(np.uint8)[:, : packed.shape[1]] = packed

    def within(self, array: int, centre: np.ndarray, half: float) -> np.ndarray:
        """For each centre the set of rows in its window."""
        first = np.searchsorted(self.values[array], centre - half, "left") // self.step
        last = -(-np.searchsorted(self.values[array], centre + half, "right") // self.step)
        return self.before[array][last] ^ self.before[array][first]


def block_neighbors(
    ids: np.ndarray, packed: np.ndarray, k: int, home: np.ndarray | None = None, seed: int = 7, trace: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block its k most similar other rows and their cosines, best first; -1 where there are fewer.

    ``home`` tells the rows that are nearest to this block's pivot (all if not given). Their windows expand until what is found is alike; those of
    the others, which search at home as well, only until ``ENOUGH`` were verified.
    Equal cosines: smaller id first. The integers of ``packed`` make dot products exact, so a pair gets the same cosine in any block.
    ``trace`` takes the half width, the number of queries and the number of vectors verified of each step; an infinite width covers the arrays.
    """
    order = np.argsort(ids, kind="stable")
    ids, packed = ids[order], packed[order]
    home = np.ones(len(ids), bool) if home is None else home[order]
    n, dim = packed.shape
    exact = packed.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", exact, exact))
    unit = (exact / length[:, None]).astype(np.float32)
    projected = unit @ np.random.default_rng(seed).standard_normal((dim, ARRAYS)).astype(np.float32)
    arrays, widest = SortedArrays(projected), 2 * float(np.abs(projected).max())
    near, cosine = np.full((n, k), -1, np.int64), np.full((n, k), -2.0)
    none = np.iinfo(np.int64).max

    def verify(rows: np.ndarray, at: np.ndarray, other: np.ndarray) -> None:
        """Take the candidates ``other`` of the rows that ``at`` indexes (in order) into the k best."""
        count = np.bincount(at, minlength=len(rows))
        place = np.arange(len(at)) - (np.cumsum(count) - count)[at]
        score = np.einsum("ij,ij->i", unit[rows[at]], unit[other])
        keep = k + 3  # a few more than k, as single precision may misplace the last
        key = np.full((len(rows), max(int(count.max()), keep)), none)
        key[at, place] = (((2.0 - score) * (1 << 29)).astype(np.int64) << 32) | other
        if key.shape[1] > keep:
            key = np.partition(key, keep - 1, axis=1)[:, :keep]
        some = key != none
        found = np.where(some, key & 0xFFFFFFFF, 0)
        s = np.where(some, np.einsum("id,ijd->ij", exact[rows], exact[found]) / (length[rows, None] * length[found]), -2.0)
        found, s = np.hstack([np.where(some, found, -1), near[rows]]), np.hstack([s, cosine[rows]])
        best = np.lexsort((found, -s), axis=1)[:, :k]
        near[rows], cosine[rows] = np.take_along_axis(found, best, 1), np.take_along_axis(s, best, 1)

    for begin in range(0, n, QUERY_ROWS):
        rows = np.arange(begin, min(n, begin + QUERY_ROWS))
        seen = np.zeros((len(rows), arrays.before.shape[2]), np.uint64)
        seen[np.arange(len(rows)), rows // 64] = np.uint64(1) << (rows % 64).astype(np.uint64)
        verified, half = np.zeros(len(rows), np.int64), FIRST_HALF
        while len(rows):
            whole = half >= widest
            if whole:
                fresh = ~seen
            else:
                fresh = at_least(added_up(arrays.within(i, projected[rows, i], half) for i in range(ARRAYS)), COLLISIONS) & ~seen
            seen |= fresh
            bits = np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little").view(bool)[:, :n]
            at, other = np.nonzero(bits)
            count = np.bincount(at, minlength=len(rows))
            verified += count
            end = np.cumsum(count)
            parts = np.flatnonzero(np.diff(end // CANDIDATES, prepend=0)) if len(at) > CANDIDATES else []
            for own in np.split(np.arange(len(rows)), parts):
                a, b = (end[own[0]] - count[own[0]], end[own[-1]]) if len(own) else (0, 0)
                if b > a:
                    verify(rows[own], at[a:b] - own[0], other[a:b])
            if trace is not None:
                trace.append((np.inf if whole else half, len(rows), len(at)))
            if whole:
                break
            alike = cosine[rows, k - 1] >= 1 - (half / CERTAIN) ** 2 / 2
            more = ~alike & (home[rows] | (verified < ENOUGH + k))
            rows, seen, verified = rows[more], seen[more], verified[more]
            half *= WIDEN
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return np.where(near >= 0, ids[np.maximum(near, 0)], -1)[back], cosine[back]


def divided_neighbors(ids: np.ndarray, packed: np.ndarray, k: int, home: np.ndarray, copies: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`block_neighbors`; a large block is divided around pivots of its own, each row entering the parts of its ``copies`` nearest."""
    if len(ids) <= SPLIT_ROWS:
        return block_neighbors(ids, packed, k, home)
    order = np.argsort(ids, kind="stable")
    ids, packed, home = ids[order], packed[order], home[order]
    direction = lambda rows: packed[rows] / np.linalg.norm(packed[rows].astype(np.float64), axis=1, keepdims=True)
    wanted = len(ids) // block_rows
    sample = direction(np.random.default_rng(3).permutation(len(ids))[: 16 * wanted])
    pivots = Pivots(centred(sample, sample[:wanted]), copies)
    parts = np.concatenate([pivots.nearest(direction(np.arange(a, min(len(ids), a + 8_192)))) for a in range(0, len(ids), 8_192)])
    order_of_parts = np.argsort(parts, axis=None, kind="stable")
    row, place = np.divmod(order_of_parts, parts.shape[1])
    ends = np.flatnonzero(np.diff(parts.ravel()[order_of_parts])) + 1
    near, cosine = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -2.0)
    for own, nearest in zip(np.split(row, ends), np.split(place == 0, ends)):
        found, s = block_neighbors(ids[own], packed[own], k, home[own] & nearest)
        found, s = np.hstack([found, near[own]]), np.hstack([s, cosine[own]])
        o = np.lexsort((found, -s), axis=1)
        found, s = np.take_along_axis(found, o, 1), np.take_along_axis(s, o, 1)
        again = np.zeros(found.shape, bool)  # the same neighbour found in two parts
        again[:, 1:] = (found[:, 1:] == found[:, :-1]) & (s[:, 1:] > -2)
        o = np.argsort(again, axis=1, kind="stable")[:, :k]
        near[own], cosine[own] = np.take_along_axis(found, o, 1), np.where(np.take_along_axis(again, o, 1), -2.0, np.take_along_axis(s, o, 1))
    near = np.where(cosine > -2, near, -1)
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return near[back], cosine[back]


def fixed_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column whose values have the same size, as a matrix of bytes; nothing is turned into objects."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, chunk.offset * 4)
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(chunk), width))
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint8)


def top_similar(
    df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = K, copies: int = COPIES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each usable vector its ``k`` most similar others: columns ``id_col``, ``rank`` (from 1), ``neighbor``, ``cosine``.

    Usable are vectors of exactly ``dim`` finite values, not all zero, with an id. A repeated id counts once.
    Equal similarity: smaller id first. Fewer than k+1 usable vectors give fewer rows, none give an empty result.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dim)
    )
    rows = df.count()

    # A direction copied very often (scaled copies included) is searched for by its k + 1 smallest ids: no other copy can be among anyone's k best.
    limit = max(HEAVY_COPIES, rows // 10_000)
    # A direction is hashed from the components in 32,767ths of the largest, as compiled expressions.
    high, low = F.array_max("v").cast("double"), F.array_min("v").cast("double")  # NaN is the greatest number
    largest = F.greatest(high, -low)
    usable = ~F.exists("v", lambda x: x.isNull()) & (high < float("inf")) & (low > -float("inf")) & (largest > 0)
    key = F.xxhash64(*[F.rint(F.try_divide(F.get("v", F.lit(i)).cast("double"), largest) * 32767) + 0.0 for i in range(dim)])
    hashed = base.where(usable).select("id", key.alias("h"))
    heavy = hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h")
    heavy = spark.createDataFrame(heavy.collect(), "h long")  # at most 10,000
    followers = None
    if not heavy.isEmpty():
        copied = hashed.join(F.broadcast(heavy), "h").select("h", "id").distinct()
        first = F.row_number().over(Window.partitionBy("h").orderBy("id"))  # limited to k + 1 in each partition before the shuffle
        leaders = cut(copied.withColumn("pos", first).where(F.col("pos") <= k + 1).select("h", "id"))  # at most 10,000 x (k + 1)
        followers = copied.join(F.broadcast(leaders.select("id")), "id", "left_anti")
        base = base.join(F.broadcast(leaders.select("id").withColumn("_led", F.lit(True))), "id", "left")
        many = F.broadcast(heavy.withColumn("_many", F.lit(True)))
        base = base.withColumn("h", F.when(usable, key)).join(many, "h", "left")
        base = base.where(F.col("_many").isNull() | F.col("_led")).select("id", "v")

    # Pivots come from a bounded sample that is chosen by a hash of the id.
    wanted = int(min(MAX_PIVOTS, max(1, round(rows / block_rows))))
    buckets = max(1, rows // (4 * wanted))
    sample = base.where(F.pmod(F.xxhash64(F.col("id"), F.lit("pivot")), F.lit(buckets)) == 0).limit(16 * wanted).toPandas()
    if len(sample):
        sample = sample.sort_values("id").drop_duplicates("id")
        _, unit = unit_rows(pa.array(sample["v"].tolist(), pa.list_(pa.float32())), dim)
    else:
        unit = np.zeros((0, dim))
    _, first = np.unique(unit.astype(np.float32), axis=0, return_index=True)
    if not len(first):  # a tiny table may leave the sample empty
        unit, first = np.ones((1, dim)) / np.sqrt(dim), np.zeros(1, int)
    chosen = np.random.default_rng(1).permutation(np.sort(first))[:wanted]
    pivots = Pivots(centred(unit, unit[chosen]), copies)
    share = np.bincount(pivots.nearest(unit).ravel(), minlength=len(chosen)) / max(1, len(unit))
    tiles = np.maximum(1, np.ceil(share * rows / TILE_ROWS)).astype(np.int64)

    shared = spark.sparkContext.broadcast((pivots, tiles))  # at most MAX_PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, tiles = shared.value
        for batch in batches:
            ok, unit = unit_rows(batch.column("v"), dim)
            ids = batch.column("id").to_numpy()[ok]
            if not len(ids):
                continue
            near = pivots.nearest(unit)
            at, block = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
            home = np.arange(len(at)) % near.shape[1] == 0
            key = block << np.int64(40)
            wide = tiles[block] > 1
            if wide.any():
                parts_at, parts_key, parts_home = [at[~wide]], [key[~wide]], [home[~wide]]
                for a, b, h in zip(at[wide], block[wide], home[wide]):
                    own, g = int(ids[a]) % int(tiles[b]), int(tiles[b])
                    parts_at.append(np.full(g, a))
                    parts_home.append(np.full(g, h))
                    parts_key.append(np.array([(b << 40) | (min(own, j) << 20) | max(own, j) for j in range(g)], np.int64))
                at, key, home = np.concatenate(parts_at), np.concatenate(parts_key), np.concatenate(parts_home)
            columns = [pa.array(key), pa.array(ids[at]), pa.array(home), binary_array(quantise(unit)[at])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "id", "home", "q"])

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)
        ids = ids[first]
        packed = fixed_rows(group.column("q"), 2 * dim).view(np.int16)[first]
        home = group.column("home").to_numpy()[first]
        near, cosine = divided_neighbors(ids, packed, k, home, copies, block_rows)
        full = cosine > -1.5
        sizes = full.sum(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        found = pa.StructArray.from_arrays([pa.array(-cosine[full]), pa.array(near[full])], ["s", "o"])
        return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(offsets, found)})

    placed = base.mapInArrow(place, "block long, id long, home boolean, q binary")
    found = placed.groupBy("block").applyInArrow(search, "id long, near array<struct<s:double,o:long>>")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    if followers is not None:
        lead = F.broadcast(leaders.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("lead")))  # bounded as heavy is
        copies_best = followers.join(lead, "h").select(
            "id", F.slice(F.transform("lead", lambda o: F.struct(F.lit(-1.0).alias("s"), o.alias("o"))), 1, k).alias("near")
        )
        best = best.unionByName(copies_best)
    return best.select("id", F.posexplode("near").alias("pos", "n")).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).alias("rank"), F.col("n.o").alias("neighbor"), (-F.col("n.s")).alias("cosine")
    )


def neighbor_pairs(neighbors: DataFrame, id_col: str) -> DataFrame:
    """Distinct pairs (smaller id first) in which one is among the most similar of the other."""
    a, b = F.col(id_col), F.col("neighbor")
    return neighbors.select(F.least(a, b).alias(f"{id_col}_a"), F.greatest(a, b).alias(f"{id_col}_b")).distinct()
