from datetime import datetime

import pytest

from lamella.common import clean_key, heavy_keys, latest_rows, salted_join
from lamella.operators.references import Child, Parent, orphan_references, orphan_report
from pyspark.sql import functions as F
from tests.conftest import rows

T = [datetime(2024, 1, d) for d in range(1, 29)]
PARENT = "plate_id string, ingested_at timestamp_ntz, withdrawn_at timestamp_ntz, key string"
CHILD = "pair string, left_plate string, right_plate string, recorded_at timestamp_ntz, ingested_at timestamp_ntz, key string, kind string"


def orphans(spark, parents, children):
    p = Parent("plates", spark.createDataFrame(parents, PARENT), "plate_id", "ingested_at", "withdrawn_at")
    c = Child("pairs", spark.createDataFrame(children, CHILD), "pair", ("left_plate", "right_plate"), "plates", "recorded_at", "ingested_at")
    return orphan_references([p], [c])


def test_kinds(spark):
    parents = [
        ("A", T[0], None, "x"),
        ("late", T[9], None, "x"),
        ("gone", T[0], None, "x"),
        ("gone", T[1], T[4], "x"),
        ("back", T[0], T[1], "x"),
        ("back", T[2], None, "x"),
        (None, T[0], None, "x"),
    ]
    children = [
        ("p1", " a\t", "B", T[3], T[3], "y", "z"),  # found after trimming; missing
        ("p2", "LATE", "late ", T[3], T[9], "y", "z"),  # arrived at the same time: no case
        ("p3", "LATE", None, T[3], T[8], "y", "z"),
        ("p4", "gone", "GONE", T[4], T[5], "y", "z"),  # withdrawn at just that time
        ("p5", "gone", "back", T[3], T[5], "y", "z"),  # before it was withdrawn
        ("p6", "", "  ", T[3], T[5], "y", "z"),  # no references
        ("p7", "B", "A", T[3], T[4], "y", "z"),
        ("p7", "A", "A", T[3], T[5], "y", "z"),  # the latest row counts
        ("p8", "A", "B", None, None, "y", "z"),  # unknown times
        (None, "B", "B", T[1], T[1], "y", "z"),
        ("p1", " a\t", "B", T[3], T[3], "y", "z"),  # repeated
    ]
    got = rows(orphans(spark, parents, children), "period", "row_id", "ref_field", "kind")
    assert got == sorted(
        [
            ("2024-01", "p1", "right_plate", "missing"),
            ("2024-01", "p3", "left_plate", "late"),
            ("2024-01", "p4", "left_plate", "deleted"),
            ("2024-01", "p4", "right_plate", "deleted"),
            (None, "p8", "right_plate", "missing"),
        ],
        key=repr,
    )


def test_report_counts(spark):
    children = [("p1", "B", "C", T[3], T[3], "", ""), ("p2", "b", "C", T[3], T[3], "", "")]
    got = rows(orphan_report(orphans(spark, [], children)))
    assert got == [("pairs", "2024-01", "left_plate", "missing", 2, 1), ("pairs", "2024-01", "right_plate", "missing", 2, 1)]


def test_empty_tables(spark):
    assert orphans(spark, [], []).count() == 0
    assert orphans(spark, [("A", T[0], None, "")], []).count() == 0


def test_a_key_of_a_third_of_all_references(spark):
    n = 3_000
    children = [(f"p{i}", "HOT" if i % 3 else f"K{i}", "A", T[3], T[3], "", "") for i in range(n)]
    got = orphans(spark, [("A", T[0], None, "")], children)
    assert got.where("kind = 'missing'").count() == n


def test_very_long_keys(spark):
    long = "x" * 100_000
    assert orphans(spark, [(long, T[0], None, "")], [("p", long.upper() + " ", None, T[1], T[1], "", "")]).count() == 0


def test_latest_rows_do_not_depend_on_order(spark):
    data = [("a", 1, 5, None), ("a", 2, 1, "u"), ("a", 2, 3, None), ("a", 2, 3, None), ("b", None, 7, "v"), (None, 9, 9, "w")]
    df = spark.createDataFrame(data, "k string, t int, v int, s string")
    for n in (1, 3):
        assert rows(latest_rows(df.repartition(n), "k", "t", "k", "t", "v", "s")) == [("a", 2, 3, None), ("b", None, 7, "v")]


@pytest.mark.parametrize("text,key", [(" a ", "A"), ("﻿a\t", "A"), ("", None), (None, None), ("  ", None), ("a b", "A B")])
def test_clean_key(spark, text, key):
    df = spark.createDataFrame([(text,)], "k string")
    assert df.select(clean_key(F.col("k"))).first()[0] == key


def test_salted_join_loses_and_doubles_nothing(spark):
    big = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(0, 9_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = heavy_keys(big, "k", share=100, floor=10)
    assert [r[0] for r in hot.select("k").collect()] == [7]
    for how in ("inner", "left"):
        assert rows(salted_join(big, small, ["k"], hot, F.col("id"), how=how), "k", "id", "v") == rows(big.join(small, "k", how), "k", "id", "v")
