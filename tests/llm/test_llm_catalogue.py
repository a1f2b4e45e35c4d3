"""The queries of the subpackage: against their SQL where there is some, else their shape."""

import os

import duckdb
import pytest

import tools_compare
from skeinwork.llm import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "p1_found": ["subgraph_a", "subgraph_b"], "p2_found": ["comment_id"], "p3_found": ["term", "mark"], "p5_found": ["comment_id", "kind"], "p6_found": ["subgraph_id", "session_no"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "shared_chars"], "p2_scores": ["comment_id", "score"], "p2_rates": ["post_id", "records", "flagged", "rate"],
    "p5_redacted": ["comment_id", "comment_text", "kinds"], "p6_splits": ["subgraph_id", "component", "split"], "p8_mix": ["shard", "slot", "source", "block", "use", "n_tokens", "doc_ids", "ids"],
    "p8_shares": ["source", "documents", "available_tokens", "target_share", "tokens", "actual_share", "uses"],
}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in tools_compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert tools_compare.compare(spark, con, name, SF)


def test_every_query_is_covered():
    assert set(catalogue.QUERIES) == set(COLUMNS) | set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert rows
    assert len(rows) == len(set(rows))
