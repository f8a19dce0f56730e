"""Every registered query against DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    # a query may have nothing to return on the smallest tables
    assert problem in (None, "empty on both sides"), problem


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
