"""Flat tables from deeply nested documents, by interval labels.

A document is walked depth first. Every node (object, array or scalar, of interest or not) gets a pre-order number when the walk enters
it and a post-order number when it leaves, so a node lies within another exactly if its pre-order number is greater and its post-order
number smaller. Each kind of node becomes a table; a row's parent in another table is the row of the same document whose interval is the
narrowest that contains its own. Members keep the order in which they are written.

Documents are independent: one pass without a shuffle after the latest row of each document is known, and a large document
costs its own size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of node: where it is (member names from the node of its parent kind), what names it, and its parent kind.

    ``text``: elements are texts that name themselves; else they are objects named by the member ``key``.
    """

    name: str
    path: tuple[str, ...]
    key: str = ""
    parent: str | None = None
    text: bool = False


#: The kinds of nodes of a stored examination, parents first.
EXAM_KINDS = (
    Kind("source", ("sources",), "source_image"),
    Kind("plate", ("plates",), "plate_id", "source"),
    Kind("flag", ("qc", "flags"), "", "plate", text=True),
    Kind("neighbor", ("nearest_reference_plates",), "plate_id", "plate"),
    Kind("pair", ("bilateral_analysis",), "bilateral_pair_id"),
)


class Number(str):
    """A number of a document, as it is written there."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse(text: str) -> object:
    """Strict JSON; numbers keep their spelling; of members with the same name the last counts. Raises ValueError."""
    try:
        return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def unwrapped(value: object) -> object:
    """A text that holds a JSON object or array stands for it. A text that holds a text is a text, whatever that one holds."""
    if not isinstance(value, str) or isinstance(value, Number) or value.lstrip(" \t\r\n")[:1] not in ("{", "["):
        return value
    try:
        return parse(value)
    except ValueError:
        return value


def is_text(value: object) -> bool:
    return isinstance(value, str) and not isinstance(value, Number)


def named(value: object) -> str:
    """A key as text: empty if absent or null; numbers as written; truth values and containers as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _places(kinds: tuple[Kind, ...], parent: str | None) -> dict:
    """Where the kinds below a kind are: nested member names that end at a kind."""
    out: dict = {}
    for kind in kinds:
        if kind.parent == parent:
            at = out
            for name in kind.path[:-1]:
                at = at.setdefault(name, {})
            at[kind.path[-1]] = kind
    return out


@dataclass
class Walk:
    """The labels of one document: of each kind's nodes pre-order, post-order, position in the array as stored, key. All nodes are numbered."""

    kinds: tuple[Kind, ...]
    nodes: dict[str, list[tuple[int, int, int, str]]] = field(default_factory=dict)
    pre: int = 0
    post: int = 0

    def run(self, document: dict) -> Walk:
        self.nodes = {k.name: [] for k in self.kinds}
        self.places = {parent: _places(self.kinds, parent) for parent in (None, *self.nodes)}
        self._object(document, self.places[None])
        return self

    def _object(self, node: dict, places: dict) -> None:
        self.pre += 1
        for name, value in node.items():
            place = places.get(name)
            if place is None:
                self._other(value)
            elif isinstance(place, Kind):
                self._array(unwrapped(value), place)
            else:
                value = unwrapped(value)
                if isinstance(value, dict):
                    self._object(value, place)
                else:
                    self._other(value)
        self.post += 1

    def _array(self, value: object, kind: Kind) -> None:
        """An array of a kind; a single object or plain text in place of it is an array of one, anything else has no elements."""
        if isinstance(value, list):
            self.pre += 1
            for i, element in enumerate(value):
                self._element(i, unwrapped(element), kind)
            self.post += 1
        elif isinstance(value, dict) or is_text(value):
            self._element(0, value, kind)
        else:
            self._other(value)

    def _element(self, i: int, value: object, kind: Kind) -> None:
        if not (is_text(value) if kind.text else isinstance(value, dict)):
            self._other(value)  # it keeps its place
            return
        rows, at, pre = self.nodes[kind.name], len(self.nodes[kind.name]), self.pre
        rows.append((pre, -1, i, ""))
        if kind.text:
            self._other(value)
            key = value
        else:
            self._object(value, self.places[kind.name])
            key = named(value.get(kind.key))
        rows[at] = (pre, self.post - 1, i, key)

    def _other(self, value: object) -> None:
        """Number a node and all below it, none of which is of a kind."""
        n, stack = 1, [value]
        while stack:
            value = stack.pop()
            if isinstance(value, dict):
                value = value.values()
            elif not isinstance(value, list):
                continue
            n += len(value)
            stack += [v for v in value if isinstance(v, (dict, list))]
        self.pre += n
        self.post += n


def container(pre: np.ndarray, post: np.ndarray, outer_pre: np.ndarray, outer_post: np.ndarray) -> np.ndarray:
    """For each inner node the index of the outer node that contains it, -1 if none does. Both are in pre-order.

    Nodes of one kind do not contain each other, so only the last outer node entered before can contain the inner one.
    """
    at = np.searchsorted(outer_pre, pre) - 1
    if not len(outer_pre):
        return at
    inside = (at >= 0) & (outer_post[np.maximum(at, 0)] > post)
    return np.where(inside, at, -1)


def node_tables(text: str, kinds: tuple[Kind, ...] = EXAM_KINDS) -> dict[str, dict[str, np.ndarray | list[str]]] | None:
    """For each kind its table: ``pre``, ``post``, ``index``, ``key`` and ``parent`` (row in the parent kind's table, -1 if none). None if ``text`` is no JSON object."""
    try:
        document = unwrapped(parse(text))
    except ValueError:
        return None
    if not isinstance(document, dict):
        return None
    walk = Walk(kinds).run(document)
    out: dict[str, dict] = {}
    for kind in kinds:
        rows = walk.nodes[kind.name]
        pre, post, index = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        parent = np.full(len(rows), -1, np.int64)
        if kind.parent:
            parent = container(pre, post, out[kind.parent]["pre"], out[kind.parent]["post"])
        out[kind.name] = {"pre": pre, "post": post, "index": index, "key": [r[3] for r in rows], "parent": parent}
    return out


def latest_documents(df: DataFrame, key: str, created: str, text: str, ingested: str | None = None) -> DataFrame:
    """``key`` and ``text`` of each document's row with the latest ``created`` (text in ISO 8601, compared as an instant).

    Rows whose time cannot be read come last. Ties: the later ``ingested``, then the greater text. Null keys are left out.
    """
    order = [F.try_to_timestamp(F.col(created)).alias("at")]
    order += [F.col(ingested).alias("in")] if ingested else []
    best = F.max_by(F.struct(F.col(text).alias("t")), F.struct(*order, F.col(text).alias("t"))).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, F.col("best.t").alias(text))


def flatten(docs: DataFrame, key: str, text: str, kinds: tuple[Kind, ...] = EXAM_KINDS) -> DataFrame:
    """All node tables in one: ``key``, ``entity``, ``pre``, ``post``, ``parent_entity``, ``parent_pre``, ``item_index``, ``item_key``, ``path``.

    ``path`` holds the array positions from the outermost kind down to the node. Null texts, texts that are no JSON object and
    elements of the wrong kind give no rows; the latter keep their position.
    """
    column_type = docs.schema[key].dataType.simpleString()
    names = [key, "entity", "pre", "post", "parent_entity", "parent_pre", "item_index", "item_key", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables = node_tables(t, kinds) if t is not None else None
                if tables is None:
                    continue
                paths: dict[str, list[list[int]]] = {}
                for kind in kinds:
                    own = tables[kind.name]
                    n = len(own["key"])
                    above = paths.get(kind.parent or "", [])
                    paths[kind.name] = [[*(above[p] if p >= 0 else []), int(i)] for p, i in zip(own["parent"], own["index"])]
                    parent_pre = tables[kind.parent]["pre"] if kind.parent else np.zeros(0, np.int64)
                    columns = (
                        [k] * n, [kind.name] * n, own["pre"].tolist(), own["post"].tolist(), [kind.parent] * n,
                        [int(parent_pre[p]) if p >= 0 else None for p in own["parent"]], own["index"].tolist(), own["key"], paths[kind.name],
                    )
                    for a, b in zip(out, columns):
                        a.extend(b)
            types = [batch.schema.field(0).type, *(pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types)], names)

    return docs.select(key, text).mapInArrow(
        run,
        f"`{key}` {column_type}, entity string, pre long, post long, parent_entity string, parent_pre long, item_index long, item_key string, path array<long>",
    )


def exam_nodes(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes of examinations with the position of their source and plate as columns, -1 where a level does not apply."""
    depth = F.size("path")
    in_source = F.col("entity").isin("source", "plate", "flag", "neighbor")
    source = F.when(in_source, F.col("path")[0]).otherwise(-1)
    plate = F.when(in_source & (depth > 1), F.get("path", F.lit(1))).otherwise(-1)
    item = F.when(in_source & (depth < 3), -1).otherwise(F.col("item_index"))
    return nodes.select(
        key,
        "entity",
        source.cast("long").alias("source_index"),
        plate.cast("long").alias("plate_index"),
        item.cast("long").alias("item_index"),
        "item_key",
    )
