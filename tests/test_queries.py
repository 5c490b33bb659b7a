import pytest

from lamella.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, data_dir, name):
    compare(spark, data_dir, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql_on_more_rows(spark, larger_dir, name):
    compare(spark, larger_dir, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, data_dir, name):
    assert catalog.QUERIES[name](spark, data_dir).count() > 0


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.QUERIES) == len(set(catalog.QUERIES))
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark, data_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
