import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import gram
from quotemill.operators import pairs as P
from quotemill.operators import portfolio as PF
from quotemill.operators import stats as A


def panel(spark, data: pd.DataFrame, parts=3):
    return spark.createDataFrame(data).repartition(parts)


def cells(df, width, by):
    return {(r.i, r.j): r for r in df.select("i", "j", "n", by.alias("v")).collect()}


def test_blocks_equal_pairwise_sums(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame(rng.normal(1e6, 1, (200, 11)), columns=[f"c {i}" for i in range(11)])  # a level far above its spread
    got = gram.co_moments(panel(spark, d), gram.vector(list(d.columns)), 11, block=4)
    cov, corr = cells(got, 11, gram.covariance()), cells(got, 11, gram.correlation())
    assert len(cov) == 66
    for i in range(11):
        for j in range(i, 11):
            assert cov[i, j].v == pytest.approx(np.cov(d.iloc[:, i], d.iloc[:, j])[0, 1], rel=1e-7, abs=1e-9)
            assert corr[i, j].v == pytest.approx(np.corrcoef(d.iloc[:, i], d.iloc[:, j])[0, 1], rel=1e-7, abs=1e-9)


def test_missing_values_are_left_out_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame(rng.normal(0, 1, (60, 3)), columns=["a", "b", "c"])
    rows = [tuple(None if rng.random() < 0.3 else float(v) for v in r) for r in d.to_numpy()]
    s = spark.createDataFrame([*rows, (None, None, None)], "a double, b double, c double")
    got = {(r.i, r.j): r for r in gram.co_moments(s, gram.vector(["a", "b", "c"]), 3, block=2).withColumn("corr", gram.correlation()).collect()}
    for (i, x), (j, y) in [((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))]:
        want = s.agg(F.corr(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n")).first()
        assert got[i, j].n == want.n and got[i, j]["corr"] == pytest.approx(want.r)


def test_degenerate_panels(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert gram.co_moments(empty, gram.vector(["a", "b"]), 2).count() == 0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert A.pair_correlations(flat, ["a", "b"]).first()["corr"] is None
    assert gram.co_moments(flat, gram.vector([]), 0).count() == 0
    assert P.cointegration(spark.createDataFrame([], "ts timestamp_ntz, a double, b double"), "ts", ["a", "b"], 50).count() == 0
    with pytest.raises(ValueError):
        gram.co_moments(flat, gram.vector(["a"] * 9000), 9000)


def test_five_hundred_assets(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(0, 1, (80, 1))
    d = pd.DataFrame(common + rng.normal(0, 1, (80, 500)), columns=[f"a{i:03d}" for i in range(500)])
    wide, names = panel(spark, d), list(d.columns)
    began = time.monotonic()
    corr = A.pair_correlations(wide, names)
    assert time.monotonic() - began < 20  # planning, with the one pass for the means
    got = corr.toPandas()
    assert len(got) == 500 * 499 // 2
    want = np.corrcoef(d.to_numpy().T)
    place = {n: i for i, n in enumerate(names)}
    assert np.allclose(got["corr"], [want[place[a], place[b]] for a, b in zip(got["a"], got["b"])])


def test_pair_tests_equal_regressions(spark):
    rng = np.random.default_rng(4)
    walk = rng.normal(0, 1, 300).cumsum()
    d = pd.DataFrame({"x": walk + 50, "y": 0.5 * walk + rng.normal(0, 0.3, 300), "z": rng.normal(0, 1, 300).cumsum()})
    d.insert(0, "ts", pd.date_range("2024-01-01", periods=300))
    wide = panel(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.a, r.b): r for r in P.cointegration(wide, "ts", ["z", "y", "x"], 250).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    recent = d.tail(250)
    for (a, b), r in got.items():
        u, v = recent[a].to_numpy(), recent[b].to_numpy()
        h = np.cov(u, v)[0, 1] / v.var(ddof=1)
        s = u - h * v
        change = np.diff(s)
        design = np.column_stack([np.ones(248), s[1:-1], change[:-1]])
        beta, rss, *_ = np.linalg.lstsq(design, change[1:], rcond=None)
        t = beta[1] / np.sqrt(rss[0] / (248 - 3) * np.linalg.inv(design.T @ design)[1, 1])
        assert r.hedge_ratio == pytest.approx(h) and r.adf_t == pytest.approx(t, rel=1e-6)
        assert (r.spread, r.spread_mean, r.spread_std) == pytest.approx((s[-1], s.mean(), s.std()))
    assert got["x", "y"].cointegrated_1pct and not got["x", "z"].cointegrated_1pct


def test_correlation_limit(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 1, (120, 3))
    r[:, 1] = r[:, 0] + 0.1 * r[:, 1]
    d = pd.DataFrame(r, columns=["a", "b", "c"])
    book = spark.createDataFrame([("p", "a", "s", 0.4), ("p", "b", "s", 0.4), ("p", "c", "t", 0.1), ("p", "unknown", "t", 0.1)], "portfolio string, symbol string, sector string, weight double")
    like = PF.portfolio_correlations(book, A.covariance_matrix(panel(spark, d), ["a", "b", "c"], 1))
    out = {x.symbol: x for x in PF.limit_checks(book, 0.5, 5.0, 0.9, like, 0.7).collect()}
    own = r @ np.array([0.4, 0.4, 0.1])
    for k, s in enumerate("abc"):
        assert out[s].correlation == pytest.approx(np.corrcoef(r[:, k], own)[0, 1])
    assert not out["a"].passed and not out["b"].passed and out["c"].passed and out["unknown"].passed and out["unknown"].correlation is None
