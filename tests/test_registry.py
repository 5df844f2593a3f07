"""The registry's shape, and a few queries end to end against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


def test_every_answer_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 100


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["symbol", "n_bars", "largest_move", "largest_volume_ratio"]


@pytest.mark.parametrize("name", [
    "flagship_unusual_symbols", "win_6_macd_signal", "win_8_ema", "agg_10_pr_curve", "joi_2_as_of", "src_7_quarantine"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry_point.queries()[name](spark, FOLDER)
    want = con.sql(entry_point.oracle_sql()[name])
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)
