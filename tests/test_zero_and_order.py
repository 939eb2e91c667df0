"""Prices of 0 and below, means that are equal, and keys whose rows come in several Arrow batches."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import user as U
from quotemill.operators import joins as J
from quotemill.operators import micro as M
from quotemill.operators import rolling as X
from quotemill.operators.ordered import Panel, Series
from quotemill.plans.registry import rnd
from quotemill.plans.table_queries import _log_price
from quotemill.streaming import stateful

INF = float("inf")
S = Series(keys=("symbol",), ts="ts", tie=(), slices=4)


def prices(spark, values):
    ts = pd.date_range("2024-01-01", periods=len(values), freq="h")
    rows = [("a", t.to_pydatetime(), v, 1.0) for t, v in zip(ts, values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, volume double")


def same(got, want):
    return len(got) == len(want) and all(
        (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))) for a, b in zip(got, want))


def test_rounding_keeps_what_a_long_cannot_hold(spark):
    values = [INF, -INF, float("nan"), None, 1e17, 1.25]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(rnd("v", 2).alias("v")).collect()
    assert same([r.v for r in got], values)


def test_returns_over_zero_prices(spark):  # F1, F4
    p = Panel(prices(spark, [2.0, 0.0, 0.0, 4.0, None]), S)
    X.pct_change(p, "price", ieee=True)
    X.log_return(p, "price", ieee=True)
    X.feature_windows(p, (2,))
    got = p.done().orderBy("ts").collect()
    assert same([r.returns_1 for r in got], [None, -1.0, float("nan"), INF, None])
    assert same([r.log_returns_1 for r in got], [None, -INF, float("nan"), INF, None])
    assert same([r.log_return for r in got], [0.0, -INF, float("nan"), INF, 0.0])


def test_named_logarithm_of_zero(spark, tables):  # F2
    from quotemill.plans import table_queries

    class View:
        ticks = spark.createDataFrame([(1, 0.0, 2.0), (2, -1.0, 0.0), (3, None, 1.0), (4, 1.0, 1.0)], "tie long, price double, volume double")

    got = table_queries._named(View).orderBy("tie").collect()
    assert same([r.log_price for r in got], [-INF, float("nan"), None, 0.0]) and got[1].unit_price is None


def test_mapped_logarithm_tells_missing_from_undefined(spark):  # F3
    from quotemill.operators import project as P

    df = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, None), (4, 1.0)], "tie long, price double")
    got = P.map_batches(df.select("tie", "price", F.col("price").isNull().alias("no_price")), _log_price, "tie long, log_price double").orderBy("tie").collect()
    assert same([r.log_price for r in got], [-INF, float("nan"), None, 0.0])


def test_scalar_function_tells_missing_from_undefined(spark):  # F5
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return a / b

    U.register_scalar(spark, "share_of", share, "double")
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 1.0), (1.0, 2.0)], "a double, b double")
    assert same([r.x for r in df.selectExpr("share_of(a, b) AS x").collect()], [float("nan"), INF, None, 0.5])


def test_equal_means_do_not_cross(spark):  # F6
    rng = np.random.default_rng(5)
    values = np.round(rng.uniform(0, 100, 40), 2)
    p = Panel(prices(spark, [float(v) for v in np.concatenate([values, rng.permutation(values), rng.permutation(values)])]), S)
    X.sma_cross(p, 40, 80, "price")
    last = p.done().orderBy("ts").collect()[79::40]
    assert [r.sma_cross for r in last] == [-1, -1]


@pytest.mark.parametrize("lead, cross", [(1e-12, -1), (1e-6, 1)])
def test_a_lead_of_rounding_is_none(spark, lead, cross):  # F6
    p = Panel(prices(spark, [1.0, 1.0 + lead]), S)
    X.sma_cross(p, 1, 2, "price")
    assert p.done().orderBy("ts").collect()[1].sma_cross == cross


def test_edge_over_a_free_ask(spark):  # F8
    tops = spark.createDataFrame([("x", 1, 2.0, 0.0), ("y", 1, 3.0, 1.0)], "symbol string, hour int, bid double, ask double")
    pairs = spark.createDataFrame([("x", "y")], "base string, quote string")
    assert M.triangular(tops, pairs, ["hour"]).first().edge == INF


def test_spread_over_a_free_ask(spark):  # F9
    row = spark.createDataFrame([(0.0, 2.0, 5.0)], "buy_price double, sell_price double, quantity double")
    got = J.arbitrage(row).first()
    assert got.spread_bps == INF and got.pnl == 10 and not got.viable


class Cell:
    """One state variable, as far as the processors use it."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Levels(dict):
    containsKey = dict.__contains__
    removeKey = dict.pop
    updateValue = dict.__setitem__

    def iterator(self):
        return iter(self.items())


def batches(rows, size):
    return iter([rows.iloc[k:k + size].reset_index(drop=True) for k in range(0, len(rows), size)])


def test_count_windows_order_rows_over_arrow_batches():  # F7
    rng = np.random.default_rng(1)
    n = 1037
    rows = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, "s"), "tie": np.arange(n), "price": rng.uniform(1, 9, n), "volume": 1.0 * np.arange(n)})
    p = stateful.count_window_processor(20, 7)
    p.seen, p.rows = Cell(), Cell()
    got = pd.concat([w for a, b in ((0, 11), (11, 600), (600, n)) for w in p.handleInputRows(("a",), batches(rows[a:b].sample(frac=1, random_state=2), 100), None)])
    starts = range(0, n - 19, 7)
    assert list(got["window_id"]) == [s // 7 for s in starts]
    assert np.allclose(got["avg_price"], [rows["price"][s:s + 20].mean() for s in starts]) and list(got["volume"]) == [rows["volume"][s:s + 20].sum() for s in starts]


def test_live_book_orders_rows_over_arrow_batches():  # F10
    rng = np.random.default_rng(3)
    n = 900
    rows = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, "s"), "tie": np.arange(n), "sequence": np.arange(n) - np.where(rng.random(n) < 0.1, 50, 0),
                         "side": rng.choice(["bid", "ask"], n), "price": rng.integers(1, 40, n) / 2, "size": rng.integers(0, 4, n).astype(float)})
    want, top = {}, None
    for r in rows.itertuples():
        if top is None or r.sequence > top:
            top = r.sequence
            want[(r.side, r.price)] = r.size
    p = stateful.LiveBook()
    p.levels, p.last = Levels(), Cell()
    for a, b in ((0, 5), (5, 500), (500, n)):
        out = list(p.handleInputRows(("a",), batches(rows[a:b].sample(frac=1, random_state=4), 70), None))
    book = dict(zip(zip(out[-1]["side"], out[-1]["price"]), out[-1]["size"]))
    assert book == {k: v for k, v in want.items() if v} and p.last.get() == (top,)
