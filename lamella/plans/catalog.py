"""The registered queries of the core, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.plans import aggregates, integrity, rasters, reference, scalar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _part in (reference, scalar, aggregates, rasters, integrity):
    QUERIES |= _part.query.queries
    ORACLE |= _part.query.sql
