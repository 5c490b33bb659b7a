"""One consistent form of texts that look the same.

``comparison_form`` is the form for comparing: compatibility normalisation in composed form, look-alike letters and hyphens as
their plain ones, white space mapped to blanks and line ends, default-ignorable characters removed, full case folding.
``visible_form`` is the same without what a reader can see: it keeps case, raised and lowered figures, fractions and
tabs. Two texts look the same if their visible forms are equal.

Both work on distinct values: a text that many rows share is normalised once, and rows are grouped by a hash of the form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.common import checked_broadcast, cut, heavy_keys, salted_join

#: A key with fewer rows is not spread over tasks.
HOT_ROWS = 10_000

#: Letters of other scripts that look like a Latin one, in the order of their code points. All, or their other case, are confusable
#: characters of Unicode's published table (a test looks them up in the copy that Spark brings along); that table also holds pairs that a
#: reader can tell apart in running text, which are left out here.
LOOKALIKES = str.maketrans(
    {
        # Greek
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
        "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϲ": "C", "ϲ": "c",
        # Cyrillic
        "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
        "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
        "ј": "j", "Ү": "Y", "ү": "y", "Һ": "H", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W",
        # Armenian and Latin letters from the phonetic alphabet
        "Օ": "O", "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ɑ": "a", "ɡ": "g",
        # hyphens of the same length
        "\u2010": "-", "\u2011": "-",
    }
)

#: Ranges of default-ignorable code points (soft hyphen, joiners, direction and shape marks, fillers, selectors, tags).
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Kinds of compatibility characters that a reader can tell from their plain form.
VISIBLE = ("<super>", "<sub>", "<fraction>")
LINE_ENDS = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")


def _plain(ch: str) -> str:
    """A character without its compatibility form: nothing, a blank, or its decomposition with look-alikes replaced."""
    if any(a <= ord(ch) <= b for a, b in IGNORABLE):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if unicodedata.decomposition(ch).startswith(VISIBLE):
        return ch
    return unicodedata.normalize("NFKD", ch).translate(LOOKALIKES)


def _folded(ch: str) -> str:
    """A character without case, without any compatibility form, and with tabs as blanks."""
    if ch == "\t":
        return " "
    for _ in range(8):  # folding may bring forth letters to decompose or look-alikes, and the other way round
        # look-alikes come first: a capital may look like a Latin one although its small letter doesn't
        after = "".join(map(_plain, unicodedata.normalize("NFKD", ch))).casefold()
        if after == ch:
            break
        ch = after
    return ch


class _Table(dict):
    """A table for ``str.translate`` that works out a character when it first occurs."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


class _Changed(dict):
    """For each character the text that a form has in its place if that is more than ``simple`` of it, else an empty list.

    A character is None if what stands in its place changes again when looked up: a text with it goes through the table as a whole.
    """

    def __init__(self, table: _Table, simple):
        super().__init__()
        self.table, self.simple = table, simple

    def _kept(self, ch: str) -> bool:
        return unicodedata.normalize("NFC", self.table[ord(ch)]) == unicodedata.normalize("NFC", self.simple(ch))

    def __missing__(self, ch: str) -> list | None:
        new = self.table[ord(ch)]
        self[ch] = out = [] if self._kept(ch) else [(ch, new)] if all(map(self._kept, new)) else None
        return out

    def applied(self, text: str) -> str:
        """``text`` with its changed characters replaced, before ``simple``: few texts have more than some of them."""
        changes = [c for c in map(self.__getitem__, set(text)) if c != []]
        if None in changes or len(changes) > 12:
            return text.translate(self.table)
        for [(ch, new)] in changes:
            text = text.replace(ch, new)
        return self.simple(text)


_VISIBLE_TABLE, _FOLDED_TABLE = _Table(_plain), _Table(_folded)
_VISIBLE, _FOLDED = _Changed(_VISIBLE_TABLE, str), _Changed(_FOLDED_TABLE, str.casefold)


def visible_form(text: str) -> str:
    """What a reader sees of ``text``: equal for texts that look the same. Accents are put on their letters again at the end."""
    if LINE_ENDS.search(text):
        text = LINE_ENDS.sub("\n", text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _VISIBLE.applied(text))  # which undoes the tables' decomposition


def comparison_form(text: str) -> str:
    """The one form of ``text`` for comparisons; applying it again changes nothing."""
    if LINE_ENDS.search(text):
        text = LINE_ENDS.sub("\n", text)
    if text.isascii():
        return text.lower().replace("\t", " ")
    return unicodedata.normalize("NFC", _FOLDED.applied(text))


def with_forms(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``comparison`` and ``visible``: both forms of the text; null texts have null forms, empty ones empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col)).dictionary_encode()  # distinct values
            values = text.dictionary.to_pylist()
            visible = pa.array([visible_form(v) for v in values], pa.string())
            compare = pa.array([comparison_form(v) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, compare.take(text.indices), visible.take(text.indices)], names)

    names = [*df.columns, "comparison", "visible"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, comparison string, visible string")


def _fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row with a text that is not blank: id, 128-bit hashes of text, comparison form and visible form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
        for batch in batches:
            text = batch.column(1).dictionary_encode()
            values = text.dictionary.to_pylist()
            forms = []
            for v in values:
                seen = visible_form(v)
                forms.append((digest(v), digest(comparison_form(v)), digest(seen), bool(seen.strip())))
            columns = [pa.array([f[i] for f in forms], pa.binary() if i < 3 else pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c.take(text.indices) for c in columns)], ["id", "own", "compare", "seen", "some"])

    data = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    data = data.where(F.col("id").isNotNull() & F.col("t").isNotNull())
    return data.mapInArrow(run, "id long, own binary, compare binary, seen binary, some boolean").where("some").drop("some")


def forms_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row with a text: ``id_col``, ``class_id``, ``class_size``, ``look_id``, ``look_size``.

    ``class_id`` is the smallest id of the texts with the same comparison form, ``look_id`` that of those which also look the same to a
    reader: each text is linked to the representative of its looks, whatever the number of copies. Smallest ids and sizes are combined before the shuffle, then
    joined back, rows of hot classes spread over tasks. Null and blank texts have no class.
    """
    prints = cut(_fingerprints(df, id_col, text_col).select("id", "compare", "seen"))
    looks = prints.groupBy("compare", "seen").agg(F.min("id").alias("look_id"), F.count("*").alias("look_size"))
    classes = looks.groupBy("compare").agg(F.min("look_id").alias("class_id"), F.sum("look_size").alias("class_size"))
    both = looks.join(classes, "compare").drop("compare")
    joined = salted_join(prints, both, ["seen"], heavy_keys(prints, "seen"), F.col("id"))
    return joined.select(F.col("id").alias(id_col), "class_id", "class_size", "look_id", "look_size")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of ids (smaller first) whose texts differ but look the same; null, empty and blank texts are no case.

    Candidates share the comparison form; what a reader can see is then checked by the visible form. A group holds a case if its smallest and largest
    text differ, which is combined before the shuffle, so all further steps see only rows of such groups. There the different texts
    of a group are paired, and then the rows of one text with those of another, never a text's rows with each other: the
    result is as large as the definition asks. Texts of groups with very many, and rows of much-copied texts, are spread over tasks.
    """
    prints = cut(_fingerprints(df, id_col, text_col))  # read twice; texts are not
    mixed = prints.groupBy("compare", "seen").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("compare", "seen")
    rows = cut(prints.join(checked_broadcast(mixed), ["compare", "seen"], "left_semi").select("seen", "own", "id"))
    kinds = rows.select("seen", "own").distinct()
    other = kinds.withColumnRenamed("own", "own_b")
    many = rows.count() > HOT_ROWS  # fewer rows have no hot key
    joined = salted_join(kinds, other, ["seen"], heavy_keys(kinds, "seen", floor=HOT_ROWS), F.col("own")) if many else kinds.join(other, "seen")
    pairs = joined.where(F.col("own") < F.col("own_b")).select("own", "own_b")
    one, two = rows.select("own", F.col("id").alias("a")), rows.select("own", F.col("id").alias("b"))
    if many:
        hot = cut(heavy_keys(rows, "own", floor=HOT_ROWS))
        left = salted_join(one, pairs, ["own"], hot, F.col("a")).select("a", F.col("own_b").alias("own"))
        both = salted_join(two, left, ["own"], hot, F.col("b"))  # the other side may be as hot: its rows are spread in the same way
    else:
        both = two.join(one.join(pairs, "own").select("a", F.col("own_b").alias("own")), "own")
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).where(F.col("a") != F.col("b")).distinct()
