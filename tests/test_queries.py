"""Every registered query with SQL against DuckDB, over the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same
from translatome.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["trx_id", "length", "n"]


def test_registered():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
