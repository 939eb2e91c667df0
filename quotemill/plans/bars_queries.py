"""Bars, rollups, tick summaries."""

from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.plans.market import TICKS
from quotemill.plans.registry import R, query, rounded

OHLCV_COLS = f"""arg_min(price, (ts, tie)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, tie)) AS close, sum(volume) AS volume,
  {R('sum(price * volume) / nullif(sum(volume), 0)')} AS vwap, count(*) AS trade_count"""

DUCK = {"1m": "time_bucket(INTERVAL 1 MINUTE, ts)", "5m": "time_bucket(INTERVAL 5 MINUTE, ts)",
        "15m": "time_bucket(INTERVAL 15 MINUTE, ts)", "30m": "time_bucket(INTERVAL 30 MINUTE, ts)",
        "1h": "time_bucket(INTERVAL 1 HOUR, ts)", "4h": "time_bucket(INTERVAL 4 HOUR, ts)",
        "1d": "time_bucket(INTERVAL 1 DAY, ts)", "1w": "CAST(date_trunc('week', ts) AS TIMESTAMP)",
        "1M": "CAST(date_trunc('month', ts) AS TIMESTAMP)"}

for _name, _sql in DUCK.items():
    @query(f"bars_{_name if _name != '1M' else '1mo'}",
           f"WITH {TICKS} SELECT symbol, exchange, {_sql} AS bucket, {OHLCV_COLS} FROM ticks GROUP BY 1, 2, 3")
    def _bars(t, interval=_name):
        return rounded(B.ohlcv(t.ticks, interval), 6, "vwap")


@query("bars_rollup_1m_to_1h", f"""WITH {TICKS}, m AS (
  SELECT symbol, exchange, time_bucket(INTERVAL 1 MINUTE, ts) AS b, arg_min(price, (ts, tie)) AS open,
    max(price) AS high, min(price) AS low, arg_max(price, (ts, tie)) AS close, sum(volume) AS volume,
    sum(price * volume) / nullif(sum(volume), 0) AS vwap, count(*) AS trade_count
  FROM ticks GROUP BY 1, 2, 3)
SELECT symbol, exchange, time_bucket(INTERVAL 1 HOUR, b) AS bucket, arg_min(open, b) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, b) AS close, sum(volume) AS volume,
  {R('sum(vwap * volume) / nullif(sum(volume), 0)')} AS vwap, CAST(sum(trade_count) AS BIGINT) AS trade_count
FROM m GROUP BY 1, 2, 3""")
def _rollup(t):
    return rounded(B.rollup_bars(B.ohlcv(t.ticks, "1m"), "1h"), 6, "vwap")


@query("ohlcv_newest_100", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, {OHLCV_COLS}
FROM ticks WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
GROUP BY 1, 2 ORDER BY bucket DESC LIMIT 100""")
def _newest(t):
    return rounded(B.get_ohlcv(t.ticks, "click", "1h", "2024-01-05", "2024-01-25", newest=100), 6, "vwap")


SUMMARY = f"""{R('avg(price)')} AS avg_price, sum(volume) AS total_volume,
  {R('sum(price * volume) / nullif(sum(volume), 0)')} AS vwap, {R('stddev_samp(price)')} AS price_stddev,
  max(price) AS max_price, min(price) AS min_price, count(*) AS tick_count"""


@query("tick_summary_5m", f"""WITH {TICKS} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
  time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, symbol, {SUMMARY}
FROM ticks GROUP BY 1, 2, 3""")
def _summary(t):
    return rounded(B.tick_summary(t.ticks, F.window("ts", "5 minutes")), 6, "avg_price", "vwap", "price_stddev")


@query("tick_summary_sliding", f"""WITH {TICKS}, s AS (
  SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE,
     time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 10 MINUTE]) AS w FROM ticks)
SELECT w AS window_start, w + INTERVAL 15 MINUTE AS window_end, symbol, {SUMMARY} FROM s GROUP BY 1, 2, 3""")
def _sliding(t):
    return rounded(B.tick_summary(t.ticks, F.window("ts", "15 minutes", "5 minutes")), 6, "avg_price", "vwap",
                   "price_stddev")


@query("vwap_of_arrays", f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: 50 + CAST(x AS DOUBLE)) AS p,
  list_transform(embedding, lambda x: CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE abs(CAST(x AS DOUBLE)) END) AS v FROM embeddings)
SELECT vec_id, {R('list_sum(list_transform(list_zip(p, v), lambda x: x[1] * x[2])) / nullif(list_sum(v), 0)')} AS vwap FROM a""")
def _vwap_arrays(t):
    """Null where an array pair has no volume."""
    p = F.transform("embedding", lambda x: 50 + x.cast("double"))
    v = F.transform("embedding", lambda x: F.when(F.col("label") == 0, 0.0).otherwise(F.abs(x.cast("double"))))
    return rounded(t.embeddings.select("vec_id", p.alias("p"), v.alias("v")).select(
        "vec_id", B.vwap_arrays(F.col("p"), F.col("v")).alias("vwap")))
