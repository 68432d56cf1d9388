"""Every registered query runs on the small tables and equals its DuckDB oracle."""

import duckdb
import pytest

from conftest import SF_SMALL
from lodgelake.plans.registry import ORACLE, QUERIES
from lodgelake.sources.tables import DRIVER_TABLES
from tools.oracle_check import canon
import __spark_entry__ as E


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["hotel_id", "name", "city", "bookings", "revenue", "occupancy", "profit"]
    assert df.count() > 0


def test_oracles_cover_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLE) <= 2  # only non-SQL forms lack an oracle


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = canon(df.columns, df.collect(), exact=True)
    if name not in ORACLE:
        assert s_cols
        return
    r = duck.sql(ORACLE[name])
    d_cols, d_rows = canon(r.columns, r.fetchall(), exact=True)
    assert s_cols == d_cols
    assert s_rows == d_rows
