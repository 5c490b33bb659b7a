"""Registering queries with their SQL equivalents."""

from __future__ import annotations


class Registry:
    """Collects queries under their functions' names; ``sql`` is the same result in DuckDB's dialect, if SQL can express it."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add
