import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from quotemill.operators import ordered as O

S = O.Series(keys=("symbol",), ts="ts", tie=(), slices=5)


def test_index_rows_counts_each_key_from_zero(spark):
    pdf, df = make_bars(spark)
    got = O.index_rows(df, S).toPandas().sort_values(["symbol", "ts"])
    assert got["_i"].tolist() == pdf.groupby("symbol").cumcount().tolist()


@pytest.mark.parametrize("block", [1, 7, 64, 16384])
def test_panel_does_not_depend_on_block_size(spark, block):
    pdf, df = make_bars(spark)
    p = O.Panel(df, S.with_(block_rows=block))
    p.mean("m", "close", 10)
    p.std("s", "m", 5)
    p.lag("l", "close", 3)
    p.lead("d", "close", 2)
    p.ema("e", "close", span=5)
    p.wilder("w", "volume", 4, start=3)
    got = p.done().toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = pdf.groupby("symbol")["close"]
    m = g.transform(lambda x: x.rolling(10).mean())
    np.testing.assert_allclose(got["m"], m, rtol=1e-12)
    np.testing.assert_allclose(got["s"], m.groupby(pdf["symbol"]).transform(lambda x: x.rolling(5).std()), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(got["l"], g.shift(3))
    np.testing.assert_allclose(got["d"], g.shift(-2))
    np.testing.assert_allclose(got["e"], g.transform(lambda x: x.ewm(span=5, adjust=False).mean()), rtol=1e-12)

    def wilder(v):
        out, y = [], None
        for i, x in enumerate(v):
            y = None if i < 3 else v.iloc[:4].mean() if i == 3 else y + (x - y) / 4
            out.append(y)
        return pd.Series(out, index=v.index, dtype=float)

    np.testing.assert_allclose(got["w"], pdf.groupby("symbol")["volume"].transform(wilder), rtol=1e-12)


def test_long_memory_crosses_stretches(spark):
    """A span whose memory is longer than a block still equals the plain recurrence."""
    pdf, df = make_bars(spark, n=900)
    p = O.Panel(df, S.with_(block_rows=100))
    p.ema("e", "close", span=50)
    got = p.done().toPandas().sort_values(["symbol", "ts"])
    want = pdf.groupby("symbol")["close"].transform(lambda x: x.ewm(span=50, adjust=False).mean())
    np.testing.assert_allclose(got["e"], want, rtol=1e-12)


@pytest.mark.parametrize("block", [1, 7, 16384])
def test_cumulative_kinds(spark, block):
    pdf, df = make_bars(spark, n=60)
    df = df.withColumn("gap", F.when(F.col("volume") > 50, F.col("close")))
    pdf["gap"] = pdf["close"].where(pdf["volume"] > 50)
    got = O.cumulative(df, S.with_(block_rows=block), {
        "s": ("sum", "volume"), "hi": ("max", "close"), "lo": ("min", "close"), "ff": ("last", "gap"), "bf": ("next", "gap")})
    got = got.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = pdf.groupby("symbol")
    np.testing.assert_allclose(got["s"], g["volume"].cumsum())
    np.testing.assert_allclose(got["hi"], g["close"].cummax())
    np.testing.assert_allclose(got["lo"], g["close"].cummin())
    np.testing.assert_allclose(got["ff"], g["gap"].ffill())
    np.testing.assert_allclose(got["bf"], g["gap"].bfill())


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["hot"] * 500 + ["cold"] * 7, "v": np.round(rng.lognormal(0, 2, 507), 2)})
    pdf.loc[:200, "v"] = 1.5
    got = O.quantiles(spark.createDataFrame(pdf), "v", [0.01, 0.5, 0.95], ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].to_numpy(dtype=float), np.quantile(g["v"], [0.01, 0.5, 0.95]))
    whole = O.quantiles(spark.createDataFrame(pdf), "v", [0.25]).first()[0]
    assert whole == pytest.approx(np.quantile(pdf["v"], 0.25))


def test_running_totals_know_the_next_value(spark):
    df = spark.createDataFrame([("x", 1.0, 2), ("x", 4.0, 1), ("x", 9.0, 5), ("y", 3.0, 7)], "k string, v double, n long")
    got = O.running_totals(df, "v", ["n"], ["k"], slices=3).orderBy("k", "v").collect()
    assert [(r["cum_n"], r["next_value"]) for r in got] == [(2, 4.0), (3, 9.0), (8, None), (7, None)]


def test_islands(spark):
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 00:40", "2024-01-01 00:50"]), "tie": range(4)})
    from quotemill.operators.rolling import sessions

    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, tie long")
    got = sessions(df, O.Series(slices=2, block_rows=2), "30 minutes").orderBy("ts").toPandas()
    assert got["session_id"].tolist() == [1, 1, 2, 2], "a gap of exactly 30 minutes starts a session"


def test_hot_key_is_split_over_tasks(spark):
    """One key holds every row: no (key, slice) or (key, block) group is larger than a slice or a block."""
    df = spark.range(4000).selectExpr("'hot' AS symbol", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts")
    s = S.with_(block_rows=256, slices=16)
    d = O.slice_by(df.withColumn("_at", O.epoch_us("ts").cast("double")), "_at", "_slice", 16)
    assert d.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 4000 / 16 * 2
    p = O.Panel(df.withColumn("x", F.lit(1.0)), s)
    p.mean("m", "x", 20)
    assert p.block_size() == 256
    assert p.blocks().groupBy("_block").count().agg(F.max("count")).first()[0] <= 256 + 19
