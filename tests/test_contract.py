"""A part of the registered queries against their SQL; tools/check_oracle.py runs them all."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import TABLES, sorted_rows

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["bm25_multi_query", "dense_topk", "rrf_hybrid", "document_decisions", "duplicate_groups", "edge_metrics", "priority_topn",
           "policy_gate", "citation_validation", "visible_page_text", "latency_distribution", "token_windows_440_48"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, result.fetchall())


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 60
