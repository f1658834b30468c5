"""Every query of the demand dimension equals its DuckDB oracle SQL (row count, columns, value hash)."""

import os

import pytest

import __spark_entry__ as E
from dimweave.plans import REPORT_COLUMNS
from dimweave.queries.catalog import QUERIES
from dimweave.queries.compare import compare, duckdb_connection

SF_DIR = os.environ.get("DIMWEAVE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="testdata not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb_connection(SF_DIR)
    yield c
    c.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_DIR)
    assert r["columns_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert tuple(df.columns) == REPORT_COLUMNS
    assert df.count() >= 0
