"""Encoding texts with a public tokenizer, by a monoid tree reduction over each text.

A long text is halved again and again; leaves are encoded on their own and neighbours are joined. Text is cut into pieces by the
tokenizer's pattern before the vocabulary is applied, and no token crosses a piece, so joining means finding the
pieces of the whole text around the joint:

* A piece of the left part is final if the pattern cannot have looked beyond the part's end while matching it. The others
  are matched again, from the end of the last final one, with the right part's text following.
* Once such a match ends where a piece of the right part ends, the remaining pieces are the right part's own, because the
  pattern looks forward only and both continue from the same place over the same text.

So the window that is encoded again grows until what lies outside it is proven stable, and the result equals that of encoding
the text at once; it is usually a few pieces wide. The join is associative and the empty text is its unit.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts up to this many characters are leaves.
LEAF_CHARS = 16_384
#: The pattern tries at most this many characters from the start of a piece before it settles for a shorter one.
LOOK_START = 3


@lru_cache(maxsize=4)
def _coder(data: bytes) -> Coder:
    return Coder(data)


class Coder:
    """A byte-level tokenizer from the bytes of its vocabulary file (a token in base64 and its id in each line)."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in data.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes = [b""] * len(self.sizes)
        for token, i in ranks.items():
            self.sizes[i], self.bytes[i] = len(token), token

    def plain(self, text: str) -> list[int]:
        """The ids of a text encoded at once."""
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str | None, leaf: int = LEAF_CHARS) -> list[int] | np.ndarray:
        """The ids of a text; null and empty texts have none. Strings of special tokens are ordinary text."""
        if not text:
            return []
        if len(text) <= leaf:
            return self.plain(text)
        return self._reduce(text, 0, len(text), leaf).ids

    def _reduce(self, text: str, start: int, end: int, leaf: int) -> Part:
        if end - start <= leaf:
            return self._leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self._reduce(text, start, middle, leaf), self._reduce(text, middle, end, leaf))

    def _leaf(self, text: str, start: int, end: int) -> Part:
        own = text[start:end]
        ends = [m.end() for m in self.pattern.finditer(own)]
        ids = np.array(self.plain(own), np.int32)
        width = np.fromiter((len(own[a:b].encode("utf-8", "replace")) for a, b in zip([0, *ends], ends)), np.int64, len(ends))
        counts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(width)) + 1
        return Part(start, end, np.array(ends, np.int64) + start, counts.astype(np.int64), ids)

    def join(self, text: str, left: Part, right: Part) -> Part:
        """The part of ``text`` that two neighbouring parts make up."""
        if not len(left.ends):
            return right
        if not len(right.ends):
            return left
        # pieces of the left part that are final: the pattern saw at most one character behind their end
        final = bisect_left(left.ends, left.end - 1)
        while final and max(int(left.ends[final - 1]), self._start(left, final - 1) + LOOK_START) + 1 > left.end:
            final -= 1
        at = int(left.ends[final - 1]) if final else left.start
        ends, ids, counts = [], [], []
        have = int(left.counts[final - 1]) if final else 0
        total, known = have, 0
        while True:
            m = self.pattern.match(text, at, right.end)
            piece = m.group()
            at = m.end()
            own = self.plain(piece)
            ids += own
            total += len(own)
            ends.append(at)
            counts.append(total)
            if at >= right.start:
                known = bisect_left(right.ends, at)
                if known < len(right.ends) and right.ends[known] == at:
                    known += 1
                    break
        skipped = int(right.counts[known - 1])
        return Part(
            left.start,
            right.end,
            np.concatenate([left.ends[:final], np.array(ends, np.int64), right.ends[known:]]),
            np.concatenate([left.counts[:final], np.array(counts, np.int64), right.counts[known:] - skipped + total]),
            np.concatenate([left.ids[:have], np.array(ids, np.int32), right.ids[skipped:]]),
        )

    @staticmethod
    def _start(part: Part, piece: int) -> int:
        return int(part.ends[piece - 1]) if piece else part.start

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: the bytes of halves are joined up the tree, so a character may be split between tokens."""
        return self._bytes(ids).decode("utf-8", "replace")

    def _bytes(self, ids: list[int] | np.ndarray) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join([self.bytes[i] for i in ids])
        middle = len(ids) // 2
        return self._bytes(ids[:middle]) + self._bytes(ids[middle:])


@dataclass
class Part:
    """A stretch of a text: ends of its pieces, number of ids up to each end, ids."""

    start: int
    end: int
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file for the workers: it has a fixed size of under 2 MB, so it is broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """``id_col`` and ``ids`` of each row's text; a null or empty text gives an empty array, a blank one its ids.

    One pass without a shuffle. Rows are independent: repeated rows give repeated results.
    """
    data = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data.value)
        for batch in batches:
            out, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text, leaf)
                sizes.append(len(ids))
                out.append(np.asarray(ids, np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.array(np.concatenate(out)) if out else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and the ``text`` that each row's ids stand for; null ids give a null text."""
    data = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
