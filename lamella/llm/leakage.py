"""Evaluation items that appear in documents, by latent semantic retrieval with an exact check of what it finds.

1. *Words.* Texts are brought to the one form for comparisons, markup and escapes are removed, and runs of letters and digits are words.
   Documents become sequences of word numbers over the items' vocabulary, once for all items; other words get -1 and match nothing.
2. *Weights.* Document frequencies are counted over all documents; a word weighs its frequency in a passage times its rarity.
   The rarity has a floor, so words that most documents share (because many are copies, say) still count.
3. *Latent space.* A randomised decomposition of the passages-by-words matrix in one pass over the corpus: the matrix's square times random
   directions is added up, and the leading directions follow from that product alone (Nystroem's approximation). Partitions
   emit only the parts of the vocabulary that they hold, which are added by a tree of ``FAN_IN``.
4. *Candidates.* Passages (``PASSAGE`` words, every ``STEP``-th) and stretches of items are mapped into that space; pairs above
   ``COSINE`` are candidates. This is one pass with a matrix product for each block of passages. Pairs that share ``RUN``
   words in a row (the whole item, if it is shorter) are candidates whatever their cosine: what the check accepts always shares such a run.
5. *Check.* In the same pass a candidate's longest common subsequence is computed, for all pairs of a block at once as bits. Where it is long enough a
   document holds an item if ``WINDOW`` consecutive words of the item appear with at most one of them changed, dropped or added between. Where it
   is at least ``PARAPHRASE`` of the stretch, and the answer (the words with digits, else the two rarest) is there, it is a paraphrase.

Items are a stated query set. Their vocabulary is collected in groups of at most ``MAX_WORDS`` words, each of which is one numbering
and one decomposition; stretches are compared in blocks of ``ITEM_BLOCK`` items. The documents are never joined with each other, and
nothing but the sums named above reaches the driver.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.common import cut
from lamella.llm.textforms import comparison_form

WINDOW = 12
#: Every stretch of up to 13 words lies within one passage.
PASSAGE, STEP = 24, 12
#: Every stretch of 12 words of an item lies within one of its stretches.
STRETCH, STRETCH_STEP = 16, 4
RANK, EXTRA = 128, 16
COSINE = 0.35
#: Share of a stretch's words that a paraphrase has in their order.
PARAPHRASE = 0.6
#: Least weight of a word, for words that all documents share.
RARITY = 0.1
#: Of ``WINDOW`` words with one changed, dropped or added, so many in a row are left.
RUN = WINDOW // 2
#: Items whose stretches are broadcast together, and words of items that are numbered together.
ITEM_BLOCK = 5_000
MAX_WORDS = 60_000
#: Passages, and stretches of items, of a matrix product.
CHUNK = 2_048
#: Words whose sums are kept in one piece, and pieces that are added by one task of a step.
PIECE_WORDS = 1_024
FAN_IN = 64
#: Pairs of shared runs that are listed at once, or those of one run if it has more; pairs that are checked at once.
RUN_PAIRS = 1 << 20
CHECK_PAIRS = 1 << 15

INLINE_TAG = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|code|mark|small|sub|sup|font|ins|del|tt|wbr)\b[^<>]*>", re.I)
TAG = re.compile(r"<[/!?a-z][^<>]*>", re.I)
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf]|\\([\"\\/])")


def words(text: str | None) -> list[str]:
    """The words of a text: case, punctuation, white space, markup and differences that cannot be seen do not matter."""
    if not text:
        return []
    if text.lstrip()[:1] in ("{", "[") and "\\" in text:  # strings in JSON
        text = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2] or " ", text)
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    text = comparison_form(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "&" in text:
        text = comparison_form(html.unescape(text))
    for ch in set(text):
        if not (ch.isalnum() or ch.isspace()):
            text = text.replace(ch, " ")
    return text.split()


def passages(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages of sequences of word numbers, one in each row, filled up with -1; and the sequence that each row is from.

    ``flat`` holds the sequences one after the other, ``ends`` where each of them ends.
    """
    begin = np.r_[0, ends[:-1]].astype(np.int64)
    count = np.maximum(1, -(-(ends - begin - STEP) // STEP))
    owner = np.repeat(np.arange(len(ends)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (begin[owner] + STEP * number)[:, None] + np.arange(PASSAGE)
    return np.where(at < ends[owner, None], np.append(flat, np.int32(-1))[np.minimum(at, len(flat))], np.int32(-1)), owner


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that are stored as bytes, one after the other, and where each of them ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32) if data is not None else np.zeros(0, np.int32)
    return flat, ((offsets[1:] - offsets[0]) // 4).astype(np.int64)


def weighted(rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-zero entries of the passages' weights: row, word, weight. Words that repeat in a row are added up."""
    r, c = np.nonzero((rows >= 0) & (idf[rows] > 0))
    key, count = np.unique(r.astype(np.int64) * len(idf) + rows[r, c], return_counts=True)
    word = key % len(idf)
    return key // len(idf), word, count * idf[word]


def times(row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """The product of the weights with a words-by-directions matrix. ``row`` is sorted, and a word occurs once in a row.

    Rows of few entries take in their first ones at once, then their second ones, and so on; the others are one dense product.
    """
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if not len(row):
        return out
    weight = weight.astype(matrix.dtype)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    place, light = first[count <= PASSAGE], count[count <= PASSAGE]
    order = np.argsort(-light, kind="stable")
    place, light = place[order], light[order]
    for j in range(int(light.max(initial=0))):
        at = place[: np.searchsorted(-light, -j)] + j  # rows of more than j entries
        out[row[at]] += matrix[word[at]] * weight[at, None]
    heavy = np.flatnonzero(count > PASSAGE)
    if len(heavy):
        own = np.repeat(count > PASSAGE, count)
        dense = np.zeros((len(heavy), len(matrix)), matrix.dtype)
        dense[np.repeat(np.arange(len(heavy)), count[heavy]), word[own]] = weight[own]
        out[row[first[heavy]]] = dense @ matrix
    return out


def transposed_times(row: np.ndarray, word: np.ndarray, weight: np.ndarray, words: int, matrix: np.ndarray) -> np.ndarray:
    """The product of the transposed weights with a passages-by-directions matrix."""
    order = np.argsort(word, kind="stable")
    return times(word[order], row[order], weight[order], words, matrix)


def marks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each row one of 64 bits (0 for none), and all the bits of the row."""
    spread = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    bits = np.where(rows >= 0, np.uint64(1) << spread, np.uint64(0))
    return bits, np.bitwise_or.reduce(bits, axis=1)


def holds(seqs: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For pairs of a passage (rows of ``seqs``) and an item (rows of ``items``, filled up with -2, of ``lengths``): does it hold it?"""
    n, width = items.shape
    run = np.zeros((n, width + WINDOW + 2, seqs.shape[1] + WINDOW + 2), np.int8)  # common run from (item word, passage word)
    for i in range(width - 1, -1, -1):
        same = items[:, i, None] == seqs
        run[:, i, : seqs.shape[1]] = np.where(same, np.minimum(run[:, i + 1, 1 : seqs.shape[1] + 1] + 1, WINDOW), 0)
    found = (run[:, 0] >= lengths[:, None]).any(1) & (lengths > 0) & (lengths < WINDOW)
    long = lengths >= WINDOW
    found |= long & (run >= WINDOW - 1).any((1, 2))
    p, i, j = np.nonzero((run > 0) & (run < WINDOW - 1) & (long & ~found)[:, None, None])
    a = run[p, i, j].astype(np.int64)
    changed = run[p, i + a + 1, j + a + 1] >= WINDOW - 1 - a
    dropped = run[p, i + a + 1, j + a] >= WINDOW - 1 - a
    added = run[p, i + a, j + a + 1] >= WINDOW - a
    found[p[changed | dropped | added]] = True
    return found


def run_keys(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and a hash of each run of ``n`` known words in rows of word numbers."""
    width = rows.shape[1] - n + 1
    if width < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.logical_and.reduce([rows[:, j : j + width] >= 0 for j in range(n)])
    r, c = np.nonzero(known)
    key = np.zeros(len(r), np.uint64)
    for j in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (rows[r, c + j].astype(np.uint64) + np.uint64(1))
        key ^= key >> np.uint64(29)
    return r, key


def stretch_runs(rows: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The stretches' runs: for each length of runs the distinct pairs of a hash and a stretch that has it, sorted."""
    size = np.minimum(lengths, RUN)
    out = []
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        r, key = run_keys(rows[own], n)
        order = np.lexsort((r, key))
        key, r = key[order], r[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (r[1:] != r[:-1])]
        out.append((n, key[new], own[r[new]]))
    return out


def sharing(rows: np.ndarray, runs: list[tuple[int, np.ndarray, np.ndarray]], n_stretches: int) -> np.ndarray:
    """Pairs of a row and a stretch that share a run, as row x ``n_stretches`` + stretch, without doubles."""
    out = [np.zeros(0, np.int64)]
    for n, keys, owner in runs:
        r, key = run_keys(rows, n)
        first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        hit = last > first
        r, first, count = r[hit], first[hit], (last - first)[hit]
        end = np.cumsum(count)
        for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(end // RUN_PAIRS)) + 1):  # a run may be in all items
            c = count[part]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[part], c)
            out.append(np.unique(np.repeat(r[part], c).astype(np.int64) * n_stretches + owner[at]))
    return np.unique(np.concatenate(out))


def common_subsequence(passages: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each passage and its stretch, at most 31 words: one bit for each of its words."""
    width = stretches.shape[1]
    powers = (1 << np.arange(width)).astype(np.int64)
    open_ = np.full(len(passages), (1 << width) - 1, np.int64)
    for j in range(passages.shape[1]):
        word = passages[:, j]
        match = ((stretches == word[:, None]) & (word >= 0)[:, None]) @ powers
        taken = open_ & match
        open_ = ((open_ + taken) | (open_ - taken)) & ((1 << width) - 1)
    return width - np.bitwise_count(open_)


def leading_directions(product: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a square from its ``product`` with random directions (a stable Nystroem approximation)."""
    shift = np.finfo(np.float64).eps ** 0.5 * max(float(np.linalg.norm(product)), 1e-300)
    moved = product + shift * random
    core = random.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max(initial=0) * 1e-12
    root = moved @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(root, full_matrices=False)
    return left[:, :rank].astype(np.float32)


def added_up(df: DataFrame, parts: int, words: int, width: int) -> np.ndarray:
    """The sum of matrices of ``words`` rows that come in pieces: columns ``part`` (of ``parts``), ``piece`` and ``m`` (bytes).

    Pieces are added by a tree of ``FAN_IN``; the driver gets one of each.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, piece, data in zip(batch.column("part").to_pylist(), batch.column("piece").to_pylist(), batch.column("m")):
                own, key = np.frombuffer(data.as_buffer(), np.float64), (part, piece)
                total[key] = total[key] + own if key in total else own.copy()
        if total:
            yield pieces_of({key: m for key, m in total.items()})

    while True:
        parts = -(-parts // FAN_IN)
        group = F.floor(F.col("part") / FAN_IN).cast("long").alias("part")
        df = df.select(group, "piece", "m").repartition("part", "piece").mapInArrow(add, "part long, piece long, m binary")
        if parts <= 1:
            break
    out = np.zeros((words, width))
    for piece, data in df.select("piece", "m").collect():
        own = np.frombuffer(data, np.float64).reshape(-1, width)
        out[piece * PIECE_WORDS : piece * PIECE_WORDS + len(own)] += own
    return out


def pieces_of(pieces: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(pieces)
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([pieces[k].tobytes() for k in keys], pa.binary())], ["part", "piece", "m"])


def own_pieces(matrix: np.ndarray) -> pa.RecordBatch | None:
    """The pieces of a partition's matrix that are not all zero."""
    part = TaskContext.get().partitionId()
    some = {(part, i): matrix[a : a + PIECE_WORDS] for i, a in enumerate(range(0, len(matrix), PIECE_WORDS)) if matrix[a : a + PIECE_WORDS].any()}
    return pieces_of(some) if some else None


@dataclass
class Stretches:
    """The stretches of some items: word numbers (filled up with -2), how many, the item's position, whether it is short, answers."""

    rows: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    short: np.ndarray
    answer: np.ndarray
    names: list

    @classmethod
    def of(cls, block: list[tuple], vocabulary: dict[str, int], idf: np.ndarray) -> Stretches:
        rows, owner, short, answer = [], [], [], []
        digits = np.array([any(ch.isdigit() for ch in w) for w in vocabulary], bool)  # in the order of the numbers
        for k, (_, ws) in enumerate(block):
            seq = np.array([vocabulary[w] for w in ws], np.int32)
            for s in range(0, max(1, len(seq) - STRETCH + STRETCH_STEP), STRETCH_STEP):
                own = seq[s : s + STRETCH]
                if len(own) < WINDOW <= len(seq):
                    continue  # no whole window; the one before has all of it
                asked = digits[own]
                if not asked.any():
                    asked = np.isin(own, own[np.argsort(-idf[own], kind="stable")[:2]])
                rows.append(np.r_[own, np.full(STRETCH - len(own), -2, np.int32)])
                answer.append(np.r_[asked, np.zeros(STRETCH - len(own), bool)])
                owner.append(k)
                short.append(len(seq) < WINDOW)
        rows = np.array(rows, np.int32).reshape(-1, STRETCH)
        return cls(rows, (rows >= 0).sum(1), np.array(owner, np.int64), np.array(short, bool), np.array(answer, bool).reshape(-1, STRETCH), [i for i, _ in block])


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, rank: int = RANK, cosine: float = COSINE, paraphrases: bool = False
) -> DataFrame:
    """The distinct pairs (``doc_id``, ``item_id``) of documents and the items that they hold.

    Null, empty and blank texts hold nothing and are held nowhere; an item of fewer than ``WINDOW`` words must be whole and unchanged.
    Rows with a null id are left out. Equal items and equal documents each give their own pairs. With ``paraphrases`` a third
    column ``exact`` tells pairs that are held (true) from those that are only paraphrased (false); a pair has one row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    kind = docs.schema["d"].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    fields = f"d {kind}, i {item_kind}, exact boolean"
    out = spark.createDataFrame([], fields)
    group: list[tuple] = []
    known: set[str] = set()
    for row in asked.toLocalIterator():
        ws = words(row["t"])
        if group and len(known | set(ws)) > MAX_WORDS:
            out = out.unionByName(_leaks_group(docs, group, sorted(known), fields, rank, cosine, paraphrases))
            group, known = [], set()
        if ws:
            group.append((row["i"], ws))
            known.update(ws)
    if group:
        out = out.unionByName(_leaks_group(docs, group, sorted(known), fields, rank, cosine, paraphrases))
    found = out.groupBy("d", "i").agg(F.max("exact").alias("exact"))
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), *(["exact"] if paraphrases else []))


def _leaks_group(docs: DataFrame, group: list[tuple], known: list[str], fields: str, rank: int, cosine: float, paraphrases: bool) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    vocabulary = {w: k for k, w in enumerate(known)}
    size = len(vocabulary)
    table = sc.broadcast(vocabulary)  # at most MAX_WORDS, or one item's
    kind = docs.schema["d"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value.get
        for batch in batches:
            text = batch.column(1).dictionary_encode()
            split = [words(t) for t in text.dictionary.to_pylist()]
            size = np.array([len(ws) for ws in split], np.int64)
            seq = np.fromiter(map(of, chain.from_iterable(split), repeat(-1)), np.int32, int(size.sum()))
            offsets = np.r_[0, np.cumsum(size)] * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(seq)])
            before = np.r_[0, np.cumsum(seq >= 0)]
            some = pa.array(before[offsets[1:] // 4] > before[offsets[:-1] // 4]).take(text.indices)  # other documents hold nothing
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), data.take(text.indices.filter(some)).cast(pa.binary())], ["d", "seq"])

    total = docs.count()
    numbered = cut(docs.mapInArrow(number, f"d {kind}, seq binary"))
    parts = numbered.rdd.getNumPartitions()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((size, 1))
        for batch in batches:
            flat, ends = sequences(batch.column("seq"))
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            once = np.unique(doc[flat >= 0] * size + flat[flat >= 0]) % size
            df[:, 0] += np.bincount(once, minlength=size)
        if (out := own_pieces(df)) is not None:
            yield out

    df = added_up(numbered.mapInArrow(frequencies, "part long, piece long, m binary"), parts, size, 1)[:, 0]
    idf = np.maximum(RARITY, np.log((1.0 + total) / (1.0 + df))).astype(np.float32)

    directions = min(rank + EXTRA, size)
    random = np.random.default_rng(11).standard_normal((size, directions))
    start = sc.broadcast((idf, random.astype(np.float32)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            rows, _ = passages(*sequences(batch.column("seq")))
            yield from (rows[a : a + CHUNK] for a in range(0, len(rows), CHUNK))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The transposed weights times the weights times random directions, of a partition."""
        idf, random = start.value
        out = np.zeros((size, directions))
        for rows in chunks(batches):
            r, w, x = weighted(rows, idf)
            y = times(r, w, x, len(rows), random)
            own, at = np.unique(w, return_inverse=True)
            out[own] += transposed_times(r, at, x, len(own), y)
        if (pieces := own_pieces(out)) is not None:
            yield pieces

    product = added_up(numbered.mapInArrow(reach, "part long, piece long, m binary"), parts, size, directions)
    leading = leading_directions(product, random.astype(np.float32).astype(np.float64), rank)

    out = None
    for begin in range(0, len(group), ITEM_BLOCK):
        asked = Stretches.of(group[begin : begin + ITEM_BLOCK], vocabulary, idf)
        found = numbered.mapInArrow(finder(sc, asked, idf, leading, cosine, paraphrases), fields)
        out = found if out is None else out.unionByName(found)
    return out


def finder(sc, asked: Stretches, idf: np.ndarray, leading: np.ndarray, cosine: float, paraphrases: bool):
    """The pass that maps numbered documents to the items of ``asked`` that they hold."""
    place = _normed(times(*weighted(np.where(asked.rows < 0, -1, asked.rows), idf), len(asked.rows), leading))
    shared = sc.broadcast((idf, leading, np.ascontiguousarray(place.T), asked, stretch_runs(asked.rows, asked.lengths)))  # ITEM_BLOCK items at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, leading, place, asked, runs = shared.value
        n = len(asked.rows)
        _, bits = marks(asked.rows)
        for batch in batches:
            rows, doc = passages(*sequences(batch.column("seq")))
            known = (rows >= 0).sum(1)
            # fewer known words than any stretch needs hold nothing
            need = np.ceil(PARAPHRASE * asked.lengths) if paraphrases else np.where(asked.short, asked.lengths, WINDOW - 1)
            able = known >= need.min()
            rows, doc, known = rows[able], doc[able], known[able]
            pairs: dict[tuple[int, int], bool] = {}
            for a in range(0, len(rows), CHUNK):
                part, part_doc = rows[a : a + CHUNK], doc[a : a + CHUNK]
                part_bits, _ = marks(part)
                latent = _normed(times(*weighted(part, idf), len(part), leading))
                key = [sharing(part, runs, n)]
                for b in range(0, n, CHUNK):
                    near = np.flatnonzero(latent @ place[:, b : b + CHUNK] >= cosine)
                    p, q = np.divmod(near, min(CHUNK, n - b))
                    enough = known[a + p] >= need[b + q]
                    key.append(p[enough] * n + b + q[enough])
                key = np.unique(np.concatenate(key))
                for b in range(0, len(key), CHECK_PAIRS):
                    p, q = np.divmod(key[b : b + CHECK_PAIRS], n)
                    # words whose bit is among the stretch's: at least as many as they have in common
                    common = ((part_bits[p] & bits[q, None]) != 0).sum(1)
                    p, q = p[common >= need[q]], q[common >= need[q]]
                    own, stretch = part[p], asked.rows[q]
                    length = common_subsequence(own, stretch)
                    good = length >= need[q]
                    p, q, own, stretch, length = p[good], q[good], own[good], stretch[good], length[good]
                    exact = holds(own, stretch, np.where(asked.short[q], asked.lengths[q], np.maximum(asked.lengths[q], WINDOW)))
                    keep = exact
                    if paraphrases:
                        there = (stretch[:, :, None] == own[:, None, :]).any(2)
                        keep = exact | (there | ~asked.answer[q]).all(1)
                    for d, k, e in zip(part_doc[p[keep]].tolist(), asked.owner[q[keep]].tolist(), exact[keep].tolist()):
                        pairs[d, k] = pairs.get((d, k), False) or e
            if pairs:
                ids = batch.column("d").take(pa.array([d for d, _ in pairs], pa.int64()))
                names = pa.array([asked.names[k] for _, k in pairs])
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(list(pairs.values()), pa.bool_())], ["d", "i", "exact"])

    return find


def _normed(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length > 0, length, 1)


def item_report(found: DataFrame, items: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """For each item the number of documents that hold it and of those that only paraphrase it; 0 for items that have not leaked.

    ``found`` is made with ``paraphrases``; without, none are counted.
    """
    exact = F.col("exact") if "exact" in found.columns else F.lit(True)
    counts = found.groupBy(item_id).agg(F.count_if(exact).alias("n_documents"), F.count_if(~exact).alias("n_paraphrases"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_paraphrases")]
    return items.select(item_id).where(F.col(item_id).isNotNull()).distinct().join(counts, item_id, "left").select(item_id, *zero)
