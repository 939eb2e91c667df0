"""The given tables seen as market data; the one place that fixes this mapping.

events -> ticks: symbol = event_type, price = value, volume = props.k, exchange by user, tie = event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.bars import ohlcv
from quotemill.operators.ordered import Panel, Series
from quotemill.session import materialize

TICKS = """ticks AS (
  SELECT event_id AS tie, ts, event_type AS symbol, 'v' || CAST(user_id % 4 AS VARCHAR) AS exchange,
         value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, user_id
  FROM events)"""

QUOTES = TICKS + """, quotes AS (
  SELECT tie, ts, symbol, exchange, price * (1 - volume / 1e5) AS bid, price * (1 + volume / 1e5) AS ask,
         volume AS bid_size, 100 - volume AS ask_size FROM ticks)"""

BARS = TICKS + """, bars AS (
  SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(price, (ts, tie)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (ts, tie)) AS close, sum(volume) AS volume,
         sum(price * volume) / nullif(sum(volume), 0) AS vwap, count(*) AS trade_count
  FROM ticks GROUP BY ALL)"""

RETURNS = """panel AS (
  SELECT o_orderdate AS ts, o_orderpriority AS asset, avg(o_totalprice) AS level FROM orders GROUP BY ALL),
returns AS (
  SELECT ts, asset, level, level / lag(level) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM panel),
daily AS (SELECT * FROM returns WHERE ret IS NOT NULL)"""

BAR_SERIES = Series(keys=("symbol",), ts="ts", tie=())
TICK_SERIES = Series(keys=("symbol",), ts="ts", tie=("tie",))
RETURN_SERIES = Series(keys=("asset",), ts="ts", tie=())


def ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("tie"),
        "ts",
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("exchange"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        "user_id",
    )


def quotes(t: DataFrame) -> DataFrame:
    half = F.col("volume") / F.lit(1e5)
    return t.select(
        "tie", "ts", "symbol", "exchange",
        (F.col("price") * (1 - half)).alias("bid"),
        (F.col("price") * (1 + half)).alias("ask"),
        F.col("volume").alias("bid_size"),
        (100 - F.col("volume")).alias("ask_size"),
    )


def symbol_bars(t: DataFrame) -> DataFrame:
    """Hourly bars per symbol over all venues, stored once so that later passes do not aggregate ticks again."""
    return materialize(ohlcv(t, "1h", keys=("symbol",)).withColumnRenamed("bucket", "ts"), "bars-1h")


def daily_returns(orders: DataFrame) -> DataFrame:
    """Five assets (order priorities), one level a day (mean order price), simple returns."""
    panel = orders.groupBy(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("asset")).agg(
        F.avg("o_totalprice").alias("level")
    )
    p = Panel(materialize(panel, "levels"), RETURN_SERIES)
    p.lag("_prev", "level")
    p.hide("_prev")
    p.add("ret", F.col("level") / F.col("_prev") - 1, ["_prev"])
    return materialize(p.done().filter("ret IS NOT NULL"), "returns")
