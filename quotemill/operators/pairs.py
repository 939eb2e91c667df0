"""Pair trading: hedge ratios, unit-root tests of spreads, signals and weights.

A spread is a combination of two columns of one aligned panel, so all sums over it follow from the co-moments of the panel's
columns, their changes and earlier changes: the work per time step is one matrix product, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.special import COINTEGRATION_CRITICAL, on_rows, unit_root_p
from quotemill.operators import gram
from quotemill.operators.ordered import Panel, Series, attach

TESTED = "a string, b string, corr double, hedge_ratio double, spread double, spread_mean double, spread_std double, n double, adf_t double"


def newest_rows(wide: DataFrame, ts: str, n: int) -> DataFrame:
    """The last n rows of the panel: a bounded top-k."""
    return wide.orderBy(F.desc(ts)).limit(n)


def hedge_ratios(wide: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Slope of a on b for every pair a < b."""
    names = sorted(assets)
    pairs = gram.named(gram.co_moments(wide, gram.vector(names), len(names)).filter("i < j"), names)
    return pairs.select("a", "b", F.try_divide("c_ij", "c_jj").alias("hedge_ratio"))


def _pair_tests(names: list[str], newest: np.ndarray, mean: np.ndarray, count: np.ndarray, cross: np.ndarray):
    """For rows of asset numbers: every pair with a later asset.  ``cross`` holds centred sums of products of levels, earlier
    levels (x), changes (y) and earlier changes (z), each for all assets.
    """
    k = len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"].tolist():
                j = np.arange(i + 1, k)
                if not len(j):
                    continue
                with np.errstate(all="ignore"):
                    h = cross[i, j] / cross[j, j]

                    def s(u: int, w: int) -> np.ndarray:
                        """Sum of products of two of the spread's parts: 0 level, 1 x, 2 y, 3 z."""
                        a, b, p, q = u * k + i, u * k + j, w * k + i, w * k + j
                        return cross[a, p] - h * (cross[a, q] + cross[b, p]) + h * h * cross[b, q]

                    xx, zz, yy, xz, xy, zy = s(1, 1), s(3, 3), s(2, 2), s(1, 3), s(1, 2), s(3, 2)
                    det = xx * zz - xz * xz
                    bx, bz = (zz * xy - xz * zy) / det, (xx * zy - xz * xy) / det
                    n = count[k + i, k + j]
                    t = bx / np.sqrt((yy - bx * xy - bz * zy) / (n - 3) * zz / det)
                    out = pd.DataFrame({
                        "a": names[i], "b": [names[x] for x in j], "corr": cross[i, j] / np.sqrt(cross[i, i] * cross[j, j]), "hedge_ratio": h,
                        "spread": newest[i] - h * newest[j], "spread_mean": mean[i] - h * mean[j], "spread_std": np.sqrt(np.maximum(s(0, 0), 0) / count[i, j]),
                        "n": n, "adf_t": t})
                yield out.replace([np.inf, -np.inf], np.nan)

    return run


def cointegration(wide: DataFrame, ts: str, assets: Sequence[str], lookback: int, min_corr: float = 0.0,
                  max_p: float | None = None, top: int | None = None) -> DataFrame:
    """Engle-Granger style test of every pair on the newest ``lookback`` rows of an aligned panel.

    The spread's change is regressed on its level and one lagged change.
    """
    names, spark = sorted(assets), wide.sparkSession
    k = len(names)
    recent = newest_rows(wide, ts, lookback).select(ts, gram.vector(names).alias("_v"), F.lit(1).alias("_one_series"))
    p = Panel(recent, Series(keys=("_one_series",), ts=ts, tie=()))
    p.lag("_v1", "_v")
    p.lag("_v2", "_v", 2)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    tested = F.concat(F.col("_v1"), minus("_v", "_v1"), minus("_v1", "_v2"))
    parts = F.concat(F.col("_v"), F.coalesce(tested, F.array_repeat(F.lit(None).cast("double"), 3 * k)))
    pairs = gram.co_moments(p.done(), parts, 4 * k).persist()
    try:
        cross, count = (gram.as_matrix(pairs, 4 * k, F.col(x)) for x in ("c_ij", "n"))
        mean = np.diag(gram.as_matrix(pairs.filter("i = j"), 4 * k, F.col("mean_i")))
    finally:
        pairs.unpersist()
    last = recent.orderBy(F.desc(ts)).limit(1).collect()  # the newest row of the panel
    newest = np.array(last[0]["_v"], float) if last else np.full(k, np.nan)
    rows = spark.range(k).mapInPandas(_pair_tests(names, newest, mean, count, cross), TESTED)
    nan = lambda x: F.when(~F.isnan(x), F.col(x))
    out = rows.withColumns({x: nan(x) for x in ("corr", "hedge_ratio", "spread", "spread_mean", "spread_std", "n", "adf_t")})
    out = out.withColumn("p_value", on_rows(lambda t: unit_root_p(t, 2), "adf_t"))
    for level, coef in COINTEGRATION_CRITICAL.items():
        crit = sum((F.lit(v) / F.pow(F.col("n"), F.lit(x)) for x, v in enumerate(coef)), F.lit(0.0))
        out = out.withColumn(f"cointegrated_{round(level * 100)}pct", F.col("adf_t") < crit)
    out = out.filter(F.abs("corr") >= min_corr).drop("n")
    if max_p is not None:
        out = out.filter(F.col("p_value") < max_p)
    return out if top is None else out.orderBy("p_value", "a", "b").limit(top)


def pair_signals(tested: DataFrame, threshold: float = 2.0) -> DataFrame:
    """z-score of the newest spread; +1 (long the spread) below -threshold, -1 above it."""
    z = F.try_divide(F.col("spread") - F.col("spread_mean"), F.col("spread_std"))
    out = tested.withColumn("z_score", z).filter("z_score IS NOT NULL")
    return out.withColumn("position", F.when(z < -threshold, 1.0).when(z > threshold, -1.0).otherwise(0.0))


def stat_arb_weights(signals: DataFrame) -> DataFrame:
    """Equal weight per active pair, opposite legs by the hedge ratio, scaled to gross exposure 1."""
    active = signals.filter("position != 0")
    count = active.agg(F.count(F.lit(1)).alias("_pairs"))
    w = F.col("position") / F.col("_pairs")
    legs = F.explode(F.array(F.struct(F.col("a").alias("asset"), w.alias("w")),
                             F.struct(F.col("b").alias("asset"), (-w * F.col("hedge_ratio")).alias("w"))))
    raw = attach(active, count).select(legs.alias("leg")).groupBy(F.col("leg.asset").alias("asset")).agg(F.sum("leg.w").alias("raw"))
    gross = raw.agg(F.sum(F.abs("raw")).alias("_gross"))
    return attach(raw, gross).select("asset", F.try_divide(F.col("raw"), F.col("_gross")).alias("weight"))
