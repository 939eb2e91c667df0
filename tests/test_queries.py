"""Registered queries against their SQL twins on the smallest tables: a fast cross-section of all modules."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from tools.check import compare

NAMES = ["bars_1h", "bars_rollup_1m_to_1h", "rolling_means", "ema_ticks", "adx", "asof_lookup", "stop_loss_triggers", "book_state", "historical_var",
         "position_book", "mann_whitney_statistics", "column_rules", "feature_set_read", "lineage_descendants", "stream_tumbling", "upsert_ticks"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()) == ""


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 280


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "exchange", "bucket", "open", "high", "low", "close", "volume", "vwap", "trade_count"]
    assert df.count() > 0


def test_registry_loads_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 280 and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
