import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotemill.session import tune  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from quotemill.plans.registry import Tables

    return Tables(spark, DATA)


def make_bars(spark, n=120, symbols=("a", "b"), seed=7):
    """Random-walk bars with unequal series: the first symbol holds most rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    parts = []
    for k, s in enumerate(symbols):
        m = n if k == 0 else n // 3
        close = 100 + rng.normal(0, 1, m).cumsum()
        open_ = close + rng.normal(0, 0.5, m)
        high = np.maximum(open_, close) + rng.uniform(0, 1, m)
        low = np.minimum(open_, close) - rng.uniform(0, 1, m)
        ts = pd.date_range("2024-01-01", periods=m, freq="h")
        parts.append(pd.DataFrame({"symbol": s, "ts": ts, "open": open_, "high": high, "low": low, "close": close,
                                   "volume": rng.integers(1, 100, m).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return pdf, spark.createDataFrame(pdf, schema)
