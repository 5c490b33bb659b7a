"""Aggregates: fractions, masked moments, first maxima, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_of(predicate: Column) -> Column:
    """The share of rows for which a predicate holds."""
    return F.avg(predicate.cast("double"))


def mean_or_zero(value: Column, mask: Column) -> Column:
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def std_or_zero(value: Column, mask: Column) -> Column:
    """Population standard deviation of the masked values; 0 if there are none."""
    return F.coalesce(F.stddev_pop(F.when(mask, value)), F.lit(0.0))


def first_largest(result: Column, size: Column, *order: Column) -> Column:
    """``result`` of the row with the largest ``size``; of equal ones the first by ``order``, which must be numbers."""
    return F.max_by(result, F.struct(size, *[-o for o in order]))


def sorted_list(*values: Column) -> Column:
    """The values of a group as a sorted array."""
    return F.array_sort(F.collect_list(F.struct(*values) if len(values) > 1 else values[0]))
