"""Small rasters in array columns, worked on in Arrow batches: a batch is one three-dimensional array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.raster import filters, shapes

SIDE = 8


def levels(vector: Column) -> Column:
    """Vector components as levels of 0 to 255."""
    return F.transform(vector, lambda e: F.floor((e.cast("double") + 0.6) / 1.2 * 255).cast("int"))


def per_grid(df: DataFrame, key: str, grid: str, fn: Callable[[np.ndarray], dict[str, np.ndarray]], fields: str, side: int = SIDE) -> DataFrame:
    """``key`` and what ``fn`` makes of the grids of a batch (grids, rows, columns). Null grids and those of another size are left out."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
            out = fn(cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n]) for n in names)], [key, *names])

    return df.where(F.size(grid) == side * side).select(key, grid).mapInArrow(run, f"`{key}` {kind}, {fields}")


def _stack(cells: np.ndarray, fill: int) -> np.ndarray:
    wide = np.pad(cells, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    h, w = cells.shape[1:]
    return np.stack([wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in shapes.AROUND])


def eroded(mask: np.ndarray) -> np.ndarray:
    return _stack(mask, True).all(0)


def dilated(mask: np.ndarray) -> np.ndarray:
    return _stack(mask, False).any(0)


def around(mask: np.ndarray) -> np.ndarray:
    """Number of the eight neighbours that are set."""
    return _stack(mask, False).sum(0) - mask


def laplacian_numerator(cells: np.ndarray) -> np.ndarray:
    """n times the sum of squares less the square of the sum of the Laplacian: its variance as an exact integer."""
    v = np.stack([filters.laplacian(g) for g in cells]).reshape(len(cells), -1)
    return v.shape[1] * (v * v).sum(1) - v.sum(1) ** 2


def component_sizes(mask: np.ndarray) -> list[np.ndarray]:
    """For each grid the number of pixels of its components."""
    return [np.bincount(shapes.components(m).ravel(), minlength=1)[1:] for m in mask]
