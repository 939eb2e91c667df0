import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from quotemill.operators import indicators as I
from quotemill.operators import patterns as P
from quotemill.operators import scans as SC
from quotemill.operators.ordered import Panel, Series

S = Series(keys=("symbol",), ts="ts", tie=(), slices=4)


def panel(df, fn, block=16384):
    p = Panel(df, S.with_(block_rows=block))
    fn(p)
    return p.done().toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_ranges_and_order(spark):
    _, df = make_bars(spark)

    def fn(p):
        I.rsi(p)
        I.rsi(p, method="wilder")
        I.bollinger(p)
        I.stochastic(p)
        I.mfi(p)
        I.aroon(p)

    got = panel(df, fn)
    for c in ("rsi_14", "rsi_wilder_14", "stochastic_k", "mfi_14", "aroon_up"):
        v = got[c].dropna()
        assert len(v) and v.between(0, 100).all(), c
    b = got.dropna(subset=["bb_upper"])
    assert (b["bb_upper"] >= b["bb_middle"]).all() and (b["bb_middle"] >= b["bb_lower"]).all()


def test_bundles_do_not_depend_on_blocks(spark):
    _, df = make_bars(spark, n=160, symbols=("a",))
    small, large = panel(df, I.baseline_panel, 32), panel(df, I.baseline_panel)
    for c in large.columns.drop(["symbol", "ts"]):
        np.testing.assert_allclose(small[c].astype(float), large[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_hand_computed(spark):
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=5, freq="D"), "open": 1.0, "high": [3.0, 5, 4, 6, 7],
                        "low": [1.0, 2, 2, 3, 5], "close": [2.0, 4, 3, 6, 6], "volume": [10.0, 20, 0, 30, 40]})
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")

    def fn(p):
        I.ema(p, 3)
        I.wma(p, 2)
        I.true_range(p)
        I.roc(p, 2)

    got = panel(df, fn, 2)
    assert got["ema_3"].tolist() == pytest.approx([2, 3, 3, 4.5, 5.25])
    assert got["wma_2"].tolist()[1:] == pytest.approx([10 / 3, 10 / 3, 5, 6])
    assert got["true_range"].tolist() == pytest.approx([2, 3, 2, 3, 2])
    assert got["roc_2"].tolist()[2:] == pytest.approx([50, 50, 100])
    tot = I.running_totals_of_volume(df, S.with_(block_rows=2)).toPandas().sort_values("ts")
    assert tot["obv"].tolist() == pytest.approx([0, 20, 20, 50, 50])


@pytest.mark.parametrize("block", [16, 16384])
def test_kama(spark, block):
    pdf, df = make_bars(spark, n=400, symbols=("a",))
    got = I.kama(df, S.with_(block_rows=block), stretch=32).toPandas().sort_values("ts")["kama"].to_numpy(dtype=float)
    x, y, want = pdf["close"].to_numpy(), None, []
    for i in range(len(x)):
        if i < 9:
            want.append(np.nan)
            continue
        if i == 9:
            y = x[9]
        else:
            noise = np.abs(np.diff(x[i - 10:i + 1])).sum()
            w = (abs(x[i] - x[i - 10]) / noise * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            y += w * (x[i] - y)
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-10)


@pytest.mark.parametrize("warm", [0, 5, 512])
def test_state_scans_are_exact_for_any_guess(spark, warm):
    """Tiny blocks and a useless warm-up force wrong guesses; the repair rounds must still give one pass."""
    _, df = make_bars(spark, n=200)
    step = SC._psar_step(0.02, 0.2)
    whole = SC.state_scan(df, S, ["high", "low"], step, ["psar"]).toPandas().sort_values(["symbol", "ts"])
    cut = SC.state_scan(df, S.with_(block_rows=40), ["high", "low"], step, ["psar"], warm=warm).toPandas().sort_values(["symbol", "ts"])
    np.testing.assert_array_equal(whole["psar"], cut["psar"])


def test_supertrend_sides(spark):
    _, df = make_bars(spark, n=200)
    got = SC.supertrend(df, S.with_(block_rows=50)).toPandas().dropna(subset=["supertrend"])
    up = got["supertrend_direction"] > 0
    assert set(got["supertrend_direction"]) <= {1.0, -1.0} and (got[up]["close"] >= got[up]["supertrend"]).mean() > 0.9


def test_affine_scan_recurses_over_blocks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=300, freq="min"), "a": rng.choice([0.0, 0.5, 1.0], 300), "u": rng.normal(size=300)})
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, a double, u double")
    got = SC.affine_scan(df, S.with_(block_rows=5), "a", "u", "y").toPandas().sort_values("ts")["y"]
    y, want = 0.0, []
    for a, u in zip(pdf["a"], pdf["u"]):
        y = a * y + u
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def _candles(spark, rows):
    """Ten quiet bars, then the given (open, high, low, close) rows."""
    quiet = [(100, 101.5, 98.5, 100 + (1 if k % 2 else -1)) for k in range(10)]
    data = [("a", pd.Timestamp("2024-01-01") + pd.Timedelta(days=k), *map(float, r)) for k, r in enumerate(quiet + rows)]
    pdf = pd.DataFrame(data, columns=["symbol", "ts", "open", "high", "low", "close"])
    return spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, open double, high double, low double, close double")


@pytest.mark.parametrize("name,rows,want", [
    ("engulfing", [(100, 100.5, 97.5, 98), (97, 103, 96.5, 102)], 100),
    ("engulfing", [(98, 100.5, 97.5, 100), (101, 101.5, 95, 96)], -100),
    ("harami", [(104, 104.5, 95.5, 96), (98, 99, 97, 98.5)], 100),
    ("hammer", [(99, 100, 96.5, 98.5), (97, 97.32, 94, 97.3)], 100),
    ("three_white_soldiers", [(95, 98.2, 94.8, 98), (97, 100.2, 96.8, 100), (99, 102.2, 98.8, 102)], 100),
    ("three_black_crows", [(102, 102.2, 98.8, 99), (100, 100.2, 96.8, 97), (98, 98.2, 94.8, 95)], -100),
    ("morning_star", [(105, 105.2, 98.8, 99), (97.5, 98, 97, 97.8), (98, 104.2, 97.9, 104)], 100),
    ("evening_star", [(95, 101.2, 94.8, 101), (102.5, 103, 102, 102.2), (102, 102.1, 95.8, 96)], -100),
    ("piercing", [(104, 104.2, 97.8, 98), (97, 102.2, 96.8, 102)], 100),
    ("dark_cloud_cover", [(96, 102.2, 95.8, 102), (103, 103.2, 97.8, 98)], -100),
    ("marubozu", [(95, 100, 95, 100)], 100),
    ("doji", [(100, 103, 97, 100.1)], 100),
    ("spinning_top", [(100, 102, 98.5, 100.5)], 100),
])
def test_patterns(spark, name, rows, want):
    p = Panel(_candles(spark, rows), S)
    P.pattern(p, name, "x")
    assert p.done().orderBy(F.desc("ts")).first()["x"] == want


def test_pattern_catalogue_is_complete():
    assert len(P.PATTERNS) == 61
    assert len(I.BASELINE_COLUMNS) == 47
