"""Every registered query with SQL against DuckDB, every other one for its rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name not in SQL:
        QUERIES[name](spark, sf).count()
        return
    problem, _ = compare(spark, con, QUERIES[name], SQL[name], sf)
    assert problem is None


def test_names_and_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
