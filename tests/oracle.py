"""Comparing a query with its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        assert not math.isnan(v), "a result has no NaN: it would compare as different"
        return v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(spark, data_dir, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, data_dir)
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert got == want
