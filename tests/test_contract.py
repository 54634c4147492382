"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as contract
from contract import registry
from tools.check import compare, views

SF_DIR = contract.SMOKE_DIR
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return views(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) > 100
    assert isinstance(duckdb.__version__, str)


def test_all_queries_are_offered():
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys()


def test_entry_is_non_empty(spark):
    df = contract.entry(spark)
    assert set(df.columns) == {"geography", "scenario", "year", "sector", "value"}
    assert not df.isEmpty()


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_matches_sql(spark, duck, key):
    ours = QUERIES[key](spark, SF_DIR).toPandas()
    assert compare(ours, duck.execute(ORACLES[key]).df()) == ""
