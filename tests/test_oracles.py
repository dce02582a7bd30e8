"""Every registered query against DuckDB (or at least run) on the smallest tables."""

import pytest
from compare import compare, connect
from conftest import SMALL

from granary.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    rows = df.collect()
    assert rows or name == "m26_feature_selection"


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() == 5
