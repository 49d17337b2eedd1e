"""Queries that SQL can express, against their DuckDB oracle."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(__file__))), "scripts"))
from check_oracle import TABLES, rows_of  # noqa: E402

from impactlens.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    want = rows_of(con.execute(queries.ORACLE[name]).df())
    assert rows_of(queries.QUERIES[name](spark, sf_small).toPandas()) == want
