import pytest

from lamella.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, data_dir, name):
    compare(spark, data_dir, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql_on_more_rows(spark, larger_dir, name):
    compare(spark, larger_dir, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, data_dir, name):
    assert queries.QUERIES[name](spark, data_dir).count() > 0


def test_columns(spark, data_dir):
    kinds = {n: queries.QUERIES[n](spark, data_dir).dtypes for n in ("p1_found", "p2_found", "p3_found", "p6_found", "p7_ids", "p8_found", "p9_found")}
    assert kinds["p1_found"] == [("plate_id_a", "string"), ("plate_id_b", "string")]
    assert kinds["p2_found"] == [("embedding_row_a", "bigint"), ("embedding_row_b", "bigint")]
    assert kinds["p3_found"] == [("source_group", "bigint"), ("bilateral_pair_id", "string")]
    assert kinds["p6_found"] == [("measure", "string"), ("tail", "string"), ("plate_id", "string")]
    assert kinds["p7_ids"] == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert kinds["p8_found"] == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert kinds["p9_found"] == [("doc_id_a", "bigint"), ("doc_id_b", "bigint")]
