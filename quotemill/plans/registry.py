"""Registered queries: a name, a Spark plan over the given tables and, where SQL can say it, the twin SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import tune

Plan = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one directory, and the market views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = tune(spark), path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def ticks(self) -> DataFrame:
        from quotemill.plans.market import ticks

        return ticks(self.events)

    @property
    def quotes(self) -> DataFrame:
        from quotemill.plans.market import quotes

        return quotes(self.ticks)

    @property
    def bars(self) -> DataFrame:
        from quotemill.plans.market import symbol_bars

        return symbol_bars(self.ticks)

    @property
    def daily_returns(self) -> DataFrame:
        from quotemill.plans.market import daily_returns

        return daily_returns(self.orders)


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run = lambda spark, path: fn(Tables(spark, path))
        run.module = fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounding that two engines compute bit for bit alike.

    The threshold is off centre, so short decimals (prices times whole volumes) never sit on it.  Numbers without
    decimals left to cut (from 2^52 on, infinite, NaN) stay: Spark's floor gives a long, which cannot hold them.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = c * F.lit(10.0**digits) + F.lit(0.4871)
    return F.when(F.abs(c) < float(1 << 52), F.floor(c)).otherwise(c) / F.lit(10.0**digits)


def R(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``rnd``."""
    return f"(floor(({expr}) * 1e{digits} + 0.4871) / 1e{digits})"


def kolmogorov(x: str) -> str:
    """SQL of the limit distribution of the scaled two-sample distance, as its alternating series."""
    series = f"list_sum(list_transform(range(1, 101), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * ({x}) * ({x}))))"
    return f"CASE WHEN ({x}) < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, {series})) END"


def integral(f: str, lo: str, width: float, steps: int = 2000) -> str:
    """SQL of the integral of ``f`` (in ``{x}``) from ``lo`` over ``width``, by Simpson's rule."""
    h = width / steps
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({h / 3!r} * list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {f.format(x=f'(({lo}) + i * {h!r})')})))"


def normal_tails(z: str) -> str:
    """SQL of the two-sided p-value of a standard normal statistic."""
    return f"(2 * {integral('exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'abs({z})', 12.0)})"


def student_tails(t: str, dof: str) -> str:
    """The same for Student's t with many degrees of freedom."""
    scale = f"exp(lgamma((({dof}) + 1) / 2) - lgamma(({dof}) / 2)) / sqrt(({dof}) * pi())"
    return f"(2 * {scale} * {integral('pow(1 + {x} * {x} / (' + dof + '), -((' + dof + ') + 1) / 2)', f'abs({t})', 40.0, 4000)})"


def chi_squared_tail(v: str, dof: str) -> str:
    """SQL of P(X > v) for a chi-squared X."""
    f = "pow({x}, (" + dof + ") / 2.0 - 1) * exp(-{x} / 2)"
    return f"({integral(f, v, 400.0, 4000)} / (pow(2, ({dof}) / 2.0) * exp(lgamma(({dof}) / 2.0))))"


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    doubles = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: rnd(c, digits) for c in doubles})
