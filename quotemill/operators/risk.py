"""Value at risk, return and risk measures over long return tables (asset, ts, ret)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import uniform_draw
from quotemill.functions.special import NORMAL, on_rows, t_quantile
from quotemill.operators import rolling as X
from quotemill.operators.ordered import Series, attach, quantiles
from quotemill.operators.stats import histogram_entropy, sample_kurtosis, sample_skew

ANNUAL = 252
ROOT = math.sqrt(ANNUAL)
c = F.col


def historical_var(df: DataFrame, keys: Sequence[str] = ("asset",), confidence: float = 0.95, ret: str = "ret", out: str = "var") -> DataFrame:
    """Lower-tail quantile of returns (a loss is negative)."""
    return quantiles(df, ret, [1 - confidence], keys, [out])


def gaussian_var(df: DataFrame, keys: Sequence[str] = ("asset",), confidence: float = 0.95, ret: str = "ret") -> DataFrame:
    z = NORMAL.inv_cdf(1 - confidence)
    return df.groupBy(*keys).agg((F.avg(ret) + z * F.stddev_samp(ret)).alias("var"))


def student_var(df: DataFrame, keys: Sequence[str] = ("asset",), confidence: float = 0.95, ret: str = "ret") -> DataFrame:
    """Mean plus the t quantile with n - 1 degrees of freedom times the deviation."""
    s = df.groupBy(*keys).agg(F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"), (F.count(ret) - 1).alias("dof"))
    return s.withColumn("var", c("m") + on_rows(lambda d: t_quantile(1 - confidence, d), "dof") * c("sd")).drop("m", "sd", "dof")


def expected_shortfall(df: DataFrame, keys: Sequence[str] = ("asset",), levels: Sequence[float] = (0.05,), ret: str = "ret") -> DataFrame:
    """Mean of the returns at or below the quantile, for each tail level (``cvar_<percent>``)."""
    names = [f"_q{round(x * 100)}" for x in levels]
    q = quantiles(df, ret, levels, keys, names)
    tail = df.join(q, list(keys)) if keys else attach(df, q)
    # The interpolated quantile can sit a rounding error below an equal return.
    return tail.groupBy(*keys).agg(*[
        F.avg(F.when(c(ret) <= c(n) + 1e-12, c(ret))).alias(f"cvar_{round(x * 100)}") for n, x in zip(names, levels)])


def monte_carlo_var(df: DataFrame, keys: Sequence[str] = ("asset",), confidence: float = 0.95, draws: int = 10000, seed: int = 7, ret: str = "ret") -> DataFrame:
    """Quantile of normal draws with each key's mean and deviation; seed, key and number decide a draw."""
    stats = df.groupBy(*keys).agg(F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
    sims = stats.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u, v = (uniform_draw(seed, *keys, "_draw", F.lit(k)) for k in ("u", "v"))
    sims = sims.withColumn("_x", c("_m") + c("_s") * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v))
    return quantiles(sims, "_x", [1 - confidence], keys, ["var"])


def portfolio_returns(df: DataFrame, weights: DataFrame, ret: str = "ret") -> DataFrame:
    """Weighted sum per time over times at which every weighted asset has a return."""
    need = weights.agg(F.count(F.lit(1)).alias("_need"))
    summed = df.join(weights, "asset").groupBy("ts").agg(F.sum(c("weight") * c(ret)).alias(ret), F.count(F.lit(1)).alias("_have"))
    return attach(summed, need).filter("_have = _need").select("ts", ret)


def var_contributions(df: DataFrame, weights: DataFrame, confidence: float = 0.95, ret: str = "ret", change: Column | float = 1.0) -> DataFrame:
    """Marginal VaR (-z x correlation with the portfolio x asset deviation / portfolio deviation), component
    (times weight) and incremental (times a change of position)."""
    z = NORMAL.inv_cdf(1 - confidence)
    port = portfolio_returns(df, weights, ret).withColumnRenamed(ret, "_p")
    per = df.join(port, "ts").groupBy("asset").agg(F.corr(ret, "_p").alias("_c"), F.stddev_samp(ret).alias("_s"), F.stddev_samp("_p").alias("_ps"))
    out = per.join(weights, "asset").withColumn("marginal_var", F.try_divide(-z * c("_c") * c("_s"), c("_ps")))
    delta = change if isinstance(change, Column) else F.lit(change)
    return out.select("asset", "marginal_var", (c("weight") * c("marginal_var")).alias("component_var"), (delta * c("marginal_var")).alias("incremental_var"))


def compounded(r: Column) -> Column:
    """Total return of an aggregate's rows; -1 if any of them is a total loss."""
    return F.when(F.min(r) <= -1, F.lit(-1.0)).otherwise(F.expm1(F.sum(F.when(r > -1, F.log1p(r)))))


def annualised(r: Column) -> Column:
    """The same brought to a year."""
    return F.when(F.min(r) <= -1, F.lit(-1.0)).otherwise(F.expm1(F.sum(F.when(r > -1, F.log1p(r))) * ANNUAL / F.count(r)))


def performance(df: DataFrame, s: Series, rf: float = 0.0, ret: str = "ret") -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, Calmar, maximum drawdown, win rate per key."""
    keys = list(s.keys)
    curve = X.equity_curve(df, s, ret)
    a = curve.groupBy(*keys).agg(
        F.count(ret).alias("periods"), compounded(c(ret)).alias("total_return"), F.avg(ret).alias("_mean"),
        annualised(c(ret)).alias("annual_return"),
        (F.stddev_samp(ret) * ROOT).alias("volatility"), (F.stddev_samp(F.when(c(ret) < 0, c(ret))) * ROOT).alias("_down"),
        F.min("drawdown").alias("max_drawdown"), F.max("periods_under").alias("drawdown_periods"),
        F.avg((c(ret) > 0).cast("double")).alias("win_rate"), sample_skew(ret).alias("skew"), sample_kurtosis(ret).alias("kurtosis"),
    )
    return a.withColumns(
        {
            "sharpe": F.try_divide(c("annual_return") - rf, c("volatility")),
            "sharpe_arithmetic": F.try_divide(c("_mean") * ANNUAL - rf, c("volatility")),
            "sortino": F.try_divide(c("annual_return") - rf, c("_down")),
            "calmar": F.try_divide(c("annual_return"), F.abs("max_drawdown")),
        }
    ).drop("_mean", "_down")


def relative_performance(df: DataFrame, bench: DataFrame, keys: Sequence[str] = ("asset",), rf: float = 0.0, ret: str = "ret") -> DataFrame:
    """Beta, alpha, tracking error and information ratio against ``bench`` (ts, bench)."""
    j = df.join(bench, "ts")
    diff = c(ret) - c("bench")
    a = j.groupBy(*keys).agg(
        F.try_divide(F.covar_samp(ret, "bench"), F.var_samp("bench")).alias("beta"),
        (F.stddev_samp(diff) * ROOT).alias("tracking_error"), F.avg(diff).alias("_active"),
        annualised(c(ret)).alias("_own"),
        annualised(c("bench")).alias("_bench"),
    )
    return a.withColumns(
        {
            "alpha": c("_own") - (rf + c("beta") * (c("_bench") - rf)),
            "information_ratio": F.try_divide(c("_active") * ANNUAL, c("tracking_error")),
        }
    ).drop("_active", "_own", "_bench")


def kelly(win_rate: Column, win_loss: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.when(win_loss > 0, win_rate - (1 - win_rate) / win_loss).otherwise(0.0), F.lit(1.0)))


def risk_report(df: DataFrame, s: Series, ret: str = "ret") -> DataFrame:
    """Volatility, Sharpe, drawdown, VaR, shortfall, tails, win rate, Kelly fraction, entropy and underwater time."""
    keys = list(s.keys)
    perf = performance(df, s, ret=ret)
    tails = expected_shortfall(df, keys, (0.01, 0.05, 0.10), ret)
    gains = df.groupBy(*keys).agg(F.avg(F.when(c(ret) > 0, c(ret))).alias("_gain"))
    out = perf.join(historical_var(df, keys, 0.95, ret, "var_95"), keys).join(tails, keys).join(gains, keys)
    out = out.join(histogram_entropy(df, ret, 20, keys), keys)
    ratio = F.abs(F.try_divide(c("cvar_5"), c("_gain")))
    return out.withColumn("kelly_fraction", kelly(c("win_rate"), ratio)).drop("_gain")


def stress(df: DataFrame, s: Series, scenarios: dict[str, Column], ret: str = "ret") -> DataFrame:
    """Apply each scenario to the returns; maximum drawdown, worst return and periods from the last high."""
    shocked = df.select(*s.keys, s.ts, *s.tie, F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), e.alias("_r")) for n, e in scenarios.items()])).alias("x"))
    shocked = shocked.select(*s.keys, s.ts, *s.tie, c("x.scenario").alias("scenario"), c("x._r").alias(ret))
    by = s.with_(keys=(*s.keys, "scenario"))
    curve = X.equity_curve(shocked, by, ret)
    return curve.groupBy(*by.keys).agg(
        F.min("drawdown").alias("max_drawdown"), F.min(ret).alias("min_return"),
        F.max("periods_under").alias("longest_recovery"), F.max_by("periods_under", s.ts).alias("open_recovery"))


# Regime -> share of the base position size; any other label gets the last one.
REGIME_SIZE = {"bull": 1.0, "sideways": 0.5, "bear": 0.2}
REGIME_SIZE_OTHER = 0.1


def regime_size(regime: str = "regime", base: float = 0.1) -> Column:
    out = F.lit(base * REGIME_SIZE_OTHER)
    for name, share in REGIME_SIZE.items():
        out = F.when(c(regime) == name, base * share).otherwise(out)
    return out
