"""Every catalogue query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "scripts"))
from check_oracle import TABLES, rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

from impactlens.plans.catalog import QUERIES  # noqa: E402

SQL = entry.oracle_sql()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(SQL) & set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_small, name):
    got = entry.queries()[name](spark, sf_small).toPandas()
    want = con.execute(SQL[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(want)
    assert c1 == c2
    assert len(got) == len(want)
    assert r1 == r2


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "report_id" in df.columns
