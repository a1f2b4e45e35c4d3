"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import tools_compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in tools_compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalogue.SQL))
def test_query(spark, con, name):
    assert tools_compare.compare(spark, con, name, SF)


@pytest.mark.parametrize("name", sorted(set(entry.catalogue.QUERIES) - set(entry.catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    """Content is tested by brute force on small cases (test_operators); here, that it holds on whole tables."""
    rows = entry.catalogue.QUERIES[name](spark, SF).collect()
    assert len({str(r) for r in rows}) == len(rows)  # the smallest tables may have no seed, and then no row


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
