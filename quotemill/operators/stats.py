"""Aggregate statistics: profiles, entropy, correlation, histograms, concentration, returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators import gram
from quotemill.operators.ordered import attach, quantiles

ANNUAL = 252


def sample_skew(x: str | Column) -> Column:
    """Bias-corrected skewness (Spark's own is the population form)."""
    c = F.col(x) if isinstance(x, str) else x
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis."""
    c = F.col(x) if isinstance(x, str) else x
    n = F.count(c)
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _stack(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("s")).select("s.*")


def column_profile(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """count, mean, std, min, max, skew, kurtosis: one row per column, one pass over the table."""
    dev = F.stddev_samp if ddof else F.stddev_pop
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), dev(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                 sample_skew(c).alias("skew"), sample_kurtosis(c).alias("kurtosis")).alias(f"_{k}")
        for k, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[f"_{k}" for k in range(len(cols))])).alias("s")).select("s.*")


def percentile_profile(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles, one row per column."""
    return quantiles(_stack(df, cols), "value", probs, ["column"])


def category_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Categories, most frequent value and its share, nulls: one row per column."""
    parts = None
    for c in cols:
        counts = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = F.max_by(F.when(F.col("v").isNotNull(), F.col("v")),
                       F.when(F.col("v").isNotNull(), F.struct("n", "v")))
        row = counts.agg(F.lit(c).alias("column"), F.count("v").alias("categories"), top.alias("mode"),
                         (F.max(F.when(F.col("v").isNotNull(), F.col("n"))) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mode_share"),
                         F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def distribution(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return attach(counts, total).select("category", "n", (F.col("n") / F.col("_t")).alias("share"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    """Shannon entropy (natural log) of a column's categories."""
    return distribution(df.filter(F.col(col).isNotNull()), col).agg((-F.sum(F.col("share") * F.log("share"))).alias("entropy"))


def value_range(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))


def bin_index(col: str | Column, bins: int) -> Column:
    """Equal-width bin between ``_lo`` and ``_hi``; the last bin includes its right edge."""
    c = F.col(col) if isinstance(col, str) else col
    pos = F.floor(F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    return F.coalesce(F.least(pos, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and densities per equal-width bin, including empty bins."""
    keys = list(keys)
    limits = value_range(df, col, keys)
    tagged = df.join(limits, keys) if keys else attach(df, limits)
    counts = tagged.filter(F.col(col).isNotNull()).groupBy(*keys, bin_index(col, bins).alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = grid.join(counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("_c", F.lit(0)))
    return out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "count",
                      F.try_divide(F.col("count"), F.col("_n") * width).alias("density"))


def histogram_entropy(df: DataFrame, col: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """-sum(h ln h) over the non-empty density bins."""
    h = histogram(df, col, bins, keys).filter("count > 0")
    return h.groupBy(*keys).agg((-F.sum(F.col("density") * F.log("density"))).alias("entropy"))


def metric_summary(df: DataFrame, labels: Sequence[str], value: str, ts: str, since) -> DataFrame:
    """count, sum, avg, min, max, std and p50 / p95 / p99 of recent values per label set."""
    recent = df.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    base = recent.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("avg"),
                                       F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
    return base.join(quantiles(recent, value, (0.5, 0.95, 0.99), labels), list(labels))


def pair_correlations(wide: DataFrame, assets: Sequence[str], min_abs: float | None = None) -> DataFrame:
    """Correlation and annualised covariance of every asset pair of the aligned panel, by one blocked product."""
    names = sorted(assets)
    pairs = gram.named(gram.co_moments(wide, gram.vector(names), len(names)).filter("i < j"), names)
    out = pairs.select("a", "b", gram.correlation().alias("corr"), (gram.covariance() * ANNUAL).alias("annual_cov"))
    return out if min_abs is None else out.filter(F.abs("corr") >= min_abs)


def covariance_matrix(wide: DataFrame, assets: Sequence[str], periods: int = ANNUAL) -> DataFrame:
    """Long form (a, b, cov) including the diagonal and both orders."""
    pairs = gram.named(gram.co_moments(wide, gram.vector(assets), len(assets)), assets)
    both = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return pairs.select(both.alias("p"), (gram.covariance() * periods).alias("cov")).select("p.a", "p.b", "cov")


def volume_profile(t: DataFrame, precision: int = 2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return t.groupBy(*keys, F.round("price", precision).alias("price_level")).agg(F.sum("volume").alias("volume"))


def completeness_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, nulls, distinct values and their ratios per column."""
    n = F.count(F.lit(1))
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column"), n.alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
                 F.count_distinct(F.col(c)).alias("distinct"), (F.count_if(F.col(c).isNull()) / n).alias("null_ratio"),
                 (F.count_distinct(F.col(c)) / n).alias("distinct_ratio")).alias(f"_{k}")
        for k, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[f"_{k}" for k in range(len(cols))])).alias("s")).select("s.*")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, and their share."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("rows"),
                   (F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_ratio"))


def concentration(weights: DataFrame, weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    return weights.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(weight)).alias("hhi"))


def win_rate(df: DataFrame, pnl: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg((F.col(pnl) > 0).cast("double")) * 100).alias("win_rate"), F.count(pnl).alias("trades"))


def portfolio_summary(positions: DataFrame, last_prices: DataFrame, cash: Column, initial: Column,
                      keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Equity, return %, number of positions and the share of them in profit."""
    held = positions.join(last_prices, "symbol")
    value = F.col("quantity") * F.col("last_price")
    pnl = F.col("quantity") * (F.col("last_price") - F.col("entry_price"))
    out = held.groupBy(*keys).agg(F.sum(value).alias("_value"), F.count(F.lit(1)).alias("positions"),
                                  (F.avg((pnl > 0).cast("double")) * 100).alias("win_rate"))
    equity = cash + F.col("_value")
    return out.select(*keys, equity.alias("equity"), ((equity / initial - 1) * 100).alias("return_pct"), "positions", "win_rate")


def signal_vote(signals: DataFrame, weight: str = "signal", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sum of signals per symbol, cut at +-0.5 to -1, 0, 1."""
    total = signals.groupBy(*keys).agg(F.sum(weight).alias("total"))
    return total.withColumn("vote", F.when(F.col("total") > 0.5, 1).when(F.col("total") < -0.5, -1).otherwise(0))


def compound(ret: str) -> Column:
    return F.exp(F.sum(F.log1p(ret))) - 1


def fold_state(df: DataFrame, keys: Sequence[str], folds: dict[str, tuple[str, str]]) -> DataFrame:
    """Keyed aggregate from named folds: sum, count, min, max, mean, product."""
    table = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg,
             "product": lambda c: F.exp(F.sum(F.log(c)))}
    return df.groupBy(*keys).agg(*[table[kind](F.col(c)).alias(out) for out, (kind, c) in folds.items()])


def annualised(mean: Column) -> Column:
    return mean * ANNUAL


def sqrt_annual() -> float:
    return math.sqrt(ANNUAL)
