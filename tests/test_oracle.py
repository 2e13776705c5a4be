"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare
from workloads.registry import TABLE_NAMES

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, oracle, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        verdict = compare(ours, oracle.execute(ORACLES[name]).df())
        assert verdict.startswith("ok"), verdict
    else:
        assert len(ours) > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
