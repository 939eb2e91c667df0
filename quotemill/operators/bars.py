"""Tick to bar aggregation, rollup of bars, and windowed tick summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordered import epoch_us
from quotemill.schemas import INTERVALS


def bucket(ts: str, interval: str) -> Column:
    """Start of the bar a timestamp falls in; weeks and months follow the calendar."""
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; one of {sorted(INTERVALS)}")
    span = INTERVALS[interval]
    if span in ("week", "month"):
        return F.date_trunc(span, F.col(ts)).cast("timestamp_ntz")
    return F.window(ts, span)["start"]


def order_key(t: DataFrame, ts: str, tie: str) -> Column:
    """One comparable value for (ts, tie).

    A whole-number tie packs into a decimal, which hash aggregation can keep in its buffer; with a struct the
    aggregate would sort the raw ticks first.
    """
    if t.schema[tie].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return epoch_us(ts).cast("decimal(18,0)") * F.expr("10000000000000000000BD") + F.col(tie).cast("decimal(19,0)")
    return F.struct(ts, tie)


def ohlcv(t: DataFrame, interval: str, keys: Sequence[str] = ("symbol", "exchange"), ts: str = "ts",
          tie: str = "tie") -> DataFrame:
    """Open, high, low, close, volume, vwap and trade count per (keys, bucket)."""
    at = order_key(t, ts, tie)
    return t.withColumn("bucket", bucket(ts, interval)).groupBy(*keys, "bucket").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def rollup_bars(bars: DataFrame, interval: str, keys: Sequence[str] = ("symbol", "exchange"),
                ts: str = "bucket") -> DataFrame:
    """Coarser bars from finer ones; vwap is weighted again by volume."""
    fine = bars.withColumnRenamed(ts, "_fine")
    return fine.withColumn("bucket", bucket("_fine", interval)).groupBy(*keys, "bucket").agg(
        F.min_by("open", "_fine").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_fine").alias("close"),
        F.sum("volume").alias("volume"),
        F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.sum("trade_count").alias("trade_count"),
    )


def coarsest_source(stored: Sequence[str], wanted: str) -> str:
    """The largest stored interval whose bars divide the wanted one (all divide calendar weeks and months)."""
    order = list(INTERVALS)
    minutes = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}
    fits = [s for s in stored if s == wanted
            or (s in minutes and wanted == "1M" and minutes[s] <= 1440)
            or (s in minutes and wanted in minutes and minutes[wanted] % minutes[s] == 0)]
    if not fits:
        raise ValueError(f"no stored interval divides {wanted}")
    return max(fits, key=order.index)


def get_ohlcv(t: DataFrame, symbol: str, interval: str, start=None, end=None, exchange: str | None = None,
              newest: int | None = None) -> DataFrame:
    """Bars of one symbol over [start, end); ``newest`` keeps the latest bars only."""
    t = t.filter(F.col("symbol") == symbol)
    if exchange is not None:
        t = t.filter(F.col("exchange") == exchange)
    if start is not None:
        t = t.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        t = t.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    bars = ohlcv(t, interval, keys=("symbol",))
    if newest is not None:
        return bars.orderBy(F.desc("bucket")).limit(newest)
    return bars


def tick_summary(t: DataFrame, window: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """avg, sum, vwap, sample deviation, max, min and count per window; the same on a batch or a stream."""
    return t.groupBy(window.alias("window"), *keys).agg(
        F.avg("price").alias("avg_price"),
        F.sum("volume").alias("total_volume"),
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
        F.stddev_samp("price").alias("price_stddev"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
        F.count(F.lit(1)).alias("tick_count"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "avg_price",
             "total_volume", "vwap", "price_stddev", "max_price", "min_price", "tick_count")


def vwap_arrays(prices: Column, volumes: Column) -> Column:
    """VWAP of paired arrays; null when empty, of unequal length or without volume."""
    pv = F.zip_with(prices, volumes, lambda p, v: p * v)
    add = lambda acc, x: acc + x
    total = F.aggregate(volumes, F.lit(0.0), add)
    return F.when((F.size(prices) == F.size(volumes)) & (F.size(prices) > 0),
                  F.try_divide(F.aggregate(pv, F.lit(0.0), add), total))
