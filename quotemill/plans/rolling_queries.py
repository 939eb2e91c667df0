"""Rolling features over ticks, hourly bars and the return panel."""


from pyspark.sql import functions as F

from quotemill.operators import rolling as X
from quotemill.operators.ordered import Panel, Series
from quotemill.plans.market import BAR_SERIES, BARS, RETURN_SERIES, RETURNS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rnd, rounded

TW = "PARTITION BY symbol ORDER BY ts, tie"
BW = "PARTITION BY symbol ORDER BY ts"
AW = "PARTITION BY asset ORDER BY ts"


def roll(agg: str, arg: str, n: int, w: str) -> str:
    """SQL rolling aggregate, null until n non-null values are in the window."""
    f = f"OVER ({w} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({arg.split(',')[0]}) {f} >= {n} THEN {agg}({arg}) {f} END)"


def pick(df, *cols):
    return df.select("symbol", "ts", *cols)


@query("price_changes", f"""WITH {TICKS} SELECT symbol, tie, {R(f'price - lag(price) OVER ({TW})')} AS diff_1,
  {R(f'price / lag(price) OVER ({TW}) - 1')} AS returns_1, {R(f'price / lag(price, 5) OVER ({TW}) - 1')} AS returns_5,
  {R(f'ln(price / lag(price) OVER ({TW}))')} AS log_returns_1,
  {R(f'coalesce(ln(price / lag(price) OVER ({TW})), 0)')} AS log_return_guarded FROM ticks""")
def _changes(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.change(p, "price")
    X.pct_change(p, "price", ieee=True)
    X.pct_change(p, "price", 5, ieee=True)
    X.log_return(p, "price", ieee=True)
    X.log_return(p, "price", out="log_return_guarded", guarded=True, ieee=True)
    return rounded(p.done().select("symbol", "tie", "diff_1", "returns_1", "returns_5", "log_returns_1",
                                   "log_return_guarded"))


SMAS = (5, 10, 14, 20, 50, 100, 200)


@query("rolling_means", f"WITH {TICKS} SELECT symbol, tie, " + ", ".join(
    f"{R(roll('avg', 'price', n, TW))} AS sma_{n}" for n in SMAS) + " FROM ticks")
def _smas(t):
    p = Panel(t.ticks, TICK_SERIES)
    for n in SMAS:
        p.mean(f"sma_{n}", "price", n)
    return rounded(p.done().select("symbol", "tie", *[f"sma_{n}" for n in SMAS]))


@query("rolling_mean_min_periods", f"""WITH {TICKS} SELECT symbol, tie,
  {R(f'avg(price) OVER ({TW} ROWS 19 PRECEDING)')} AS sma_20 FROM ticks""")
def _min_periods(t):
    p = Panel(t.ticks, TICK_SERIES)
    p.mean("sma_20", "price", 20, min_periods=1)
    return rounded(p.done().select("symbol", "tie", "sma_20"))


@query("rolling_volatility", f"""WITH {TICKS}, r AS (
  SELECT *, price / lag(price) OVER ({TW}) - 1 AS ret FROM ticks)
SELECT symbol, tie, {R(roll('stddev_samp', 'ret', 20, TW) + ' * sqrt(252)')} AS volatility_20,
  {R(roll('stddev_pop', 'ret', 20, TW) + ' * sqrt(252)')} AS volatility_pop_20 FROM r""")
def _vol(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.pct_change(p, "price")
    X.volatility(p, 20)
    X.volatility(p, 20, out="volatility_pop_20", ddof=0)
    return rounded(p.done().select("symbol", "tie", "volatility_20", "volatility_pop_20"))


@query("realized_volatility", f"""WITH {TICKS}, r AS (
  SELECT *, ln(price / lag(price) OVER ({TW})) AS lr FROM ticks)
SELECT symbol, tie, {R(roll('stddev_samp', 'lr', 20, TW) + ' * sqrt(252)')} AS realized_vol FROM r""")
def _rvol(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.log_return(p, "price")
    X.volatility(p, 20, "log_returns_1", "realized_vol")
    return rounded(p.done().select("symbol", "tie", "realized_vol"))


@query("support_resistance", f"""WITH {BARS} SELECT symbol, ts, {roll('max', 'high', 20, BW)} AS resistance,
  {roll('min', 'low', 20, BW)} AS support FROM bars""")
def _support(t):
    p = Panel(t.bars, BAR_SERIES)
    p.high("resistance", "high", 20)
    p.low("support", "low", 20)
    return pick(p.done(), "resistance", "support")


QS = (0.10, 0.25, 0.50, 0.75, 0.90)


@query("rolling_quantiles", f"WITH {TICKS} SELECT symbol, tie, " + ", ".join(
    f"""{R(f"CASE WHEN count(price) OVER ({TW} ROWS 19 PRECEDING) >= 20 THEN quantile_cont(price, {q}) OVER ({TW} ROWS 19 PRECEDING) END")}
    AS price_q{round(q * 100)}""" for q in QS) + " FROM ticks")
def _quantiles(t):
    p = Panel(t.ticks, TICK_SERIES)
    cols = X.rolling_quantiles(p, "price", 20, QS)
    return rounded(p.done().select("symbol", "tie", *cols))


@query("rolling_zscore", f"""WITH {TICKS} SELECT symbol, tie, {R(f"(price - {roll('avg', 'price', 20, TW)}) / nullif({roll('stddev_samp', 'price', 20, TW)}, 0)")} AS zscore
FROM ticks""")
def _z(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.zscore(p, "price", 20, "zscore")
    return rounded(p.done().select("symbol", "tie", "zscore"))


@query("rolling_vwap", f"""WITH {TICKS} SELECT symbol, tie,
  {R(f"{roll('sum', 'price * volume', 14, TW)} / nullif({roll('sum', 'volume', 14, TW)}, 0)")} AS vwap_14,
  {R(f"sum(price * volume) OVER ({TW} ROWS 49 PRECEDING) / nullif(sum(volume) OVER ({TW} ROWS 49 PRECEDING), 0)")} AS vwap_50
FROM ticks""")
def _rvwap(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.rolling_vwap(p, 14, "price", out="vwap_14")
    X.rolling_vwap(p, 50, "price", out="vwap_50", min_periods=1)
    return rounded(p.done().select("symbol", "tie", "vwap_14", "vwap_50"))


@query("cumulative_vwap", f"""WITH {BARS} SELECT symbol, ts,
  {R(f'sum((high + low + close) / 3 * volume) OVER ({BW}) / nullif(sum(volume) OVER ({BW}), 0)')} AS vwap_cum FROM bars""")
def _cvwap(t):
    return rounded(pick(X.cumulative_vwap(t.bars, BAR_SERIES), "vwap_cum"))


@query("volume_ratios", f"""WITH {BARS} SELECT symbol, ts, {R(roll('avg', 'volume', 20, BW))} AS volume_ma_20,
  {R(f"volume / nullif({roll('avg', 'volume', 20, BW)}, 0)")} AS volume_ratio_20,
  {R(f"coalesce(volume / nullif(avg(volume) OVER ({BW} ROWS BETWEEN 39 PRECEDING AND 1 PRECEDING), 0), 1)")} AS volume_ratio_past
FROM bars""")
def _vr(t):
    p = Panel(t.bars, BAR_SERIES)
    X.volume_ratio(p, 20)
    X.volume_ratio_to_past(p, 40)
    return rounded(pick(p.done(), "volume_ma_20", "volume_ratio_20", "volume_ratio_past"))


@query("price_to_sma", f"""WITH {BARS} SELECT symbol, ts, {R(f"close / nullif({roll('avg', 'close', 20, BW)}, 0) - 1")}
  AS price_sma_20_ratio FROM bars""")
def _psma(t):
    p = Panel(t.bars, BAR_SERIES)
    X.price_to_sma(p, 20)
    return rounded(pick(p.done(), "price_sma_20_ratio"))


@query("candle_shape", f"""WITH {BARS} SELECT symbol, ts, {R('high - low')} AS "range", {R('abs(close - open)')} AS body,
  {R('high - greatest(open, close)')} AS upper_shadow, {R('least(open, close) - low')} AS lower_shadow FROM bars""")
def _shape(t):
    p = Panel(t.bars, BAR_SERIES)
    X.candle_shape(p)
    return rounded(pick(p.done(), "range", "body", "upper_shadow", "lower_shadow"))


@query("momentum", f"""WITH {BARS} SELECT symbol, ts, {R(f'close - lag(close, 5) OVER ({BW})')} AS momentum_5,
  {R(f'close - lag(close, 10) OVER ({BW})')} AS momentum_10 FROM bars""")
def _mom(t):
    p = Panel(t.bars, BAR_SERIES)
    X.momentum(p, 5)
    X.momentum(p, 10)
    return rounded(pick(p.done(), "momentum_5", "momentum_10"))


@query("volume_weighted_range", f"""WITH {BARS} SELECT symbol, ts,
  {R(f"volume * (high - low) / nullif({roll('avg', '(high - low)', 20, BW)}, 0)", 4)} AS volume_profile FROM bars""")
def _vwr(t):
    p = Panel(t.bars, BAR_SERIES)
    X.weighted_range(p)
    return rounded(pick(p.done(), "volume_profile"), 4)


@query("forward_labels", f"""WITH {BARS}, f AS (SELECT *, (lead(close, 5) OVER ({BW}) - close) / close AS r FROM bars)
SELECT symbol, ts, CASE WHEN r > 0.01 THEN 1 WHEN r < -0.01 THEN -1 ELSE 0 END AS label FROM f""")
def _label(t):
    p = Panel(t.bars, BAR_SERIES)
    X.forward_label(p)
    return pick(p.done(), "label")


@query("equity_and_drawdown", f"""WITH {RETURNS}, e AS (
  SELECT asset, ts, exp(sum(ln(1 + ret)) OVER ({AW})) AS equity FROM daily)
SELECT asset, ts, {R('equity / max(equity) OVER (' + AW + ') - 1')} AS drawdown, {R('ln(equity)')} AS log_equity FROM e""")
def _equity(t):
    e = X.equity_curve(t.daily_returns, RETURN_SERIES)
    return e.select("asset", "ts", rnd("drawdown").alias("drawdown"), rnd(F.log("equity")).alias("log_equity"))


@query("drawdown_duration", f"""WITH {RETURNS}, e AS (
  SELECT asset, ts, exp(sum(ln(1 + ret)) OVER ({AW})) AS equity FROM daily),
u AS (SELECT *, (equity / max(equity) OVER ({AW}) - 1 < -1e-12)::INT AS under FROM e),
g AS (SELECT *, sum(1 - under) OVER ({AW}) AS island FROM u)
SELECT asset, CAST(max(n) AS BIGINT) AS max_drawdown_periods
FROM (SELECT asset, island, sum(under) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def _ddur(t):
    return X.drawdown_duration(t.daily_returns, RETURN_SERIES)


@query("rolling_risk", f"""WITH {RETURNS}, m AS (SELECT ts, avg(ret) AS bench FROM daily GROUP BY ts),
j AS (SELECT d.*, m.bench FROM daily d JOIN m USING (ts))
SELECT asset, ts, {R(roll('avg', 'ret', 60, AW) + ' * 252', 4)} AS rolling_return,
  {R(roll('stddev_samp', 'ret', 60, AW) + ' * sqrt(252)', 4)} AS rolling_volatility,
  {R(f"{roll('avg', 'ret', 60, AW)} * sqrt(252) / {roll('stddev_samp', 'ret', 60, AW)}", 4)} AS rolling_sharpe,
  {R(f"{roll('covar_samp', 'ret, bench', 60, AW)} / {roll('var_samp', 'bench', 60, AW)}", 4)} AS rolling_beta FROM j""")
def _rr(t):
    d = t.daily_returns
    p = Panel(d.join(d.groupBy("ts").agg(F.avg("ret").alias("bench")), "ts"), RETURN_SERIES)
    X.rolling_risk(p, "ret", "bench")
    return rounded(p.done().select("asset", "ts", "rolling_return", "rolling_volatility", "rolling_sharpe",
                                   "rolling_beta"), 4)


@query("rolling_pair_correlation", f"""WITH {RETURNS}, w AS (
  SELECT ts, max(level) FILTER (asset = '1-URGENT') AS a, max(level) FILTER (asset = '2-HIGH') AS b
  FROM panel GROUP BY ts), v AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT ts, {R('CASE WHEN count(a) OVER (ORDER BY ts ROWS 99 PRECEDING) >= 100 THEN corr(a, b) OVER (ORDER BY ts ROWS 99 PRECEDING) END')} AS corr_100,
  {R('CASE WHEN count(a) OVER (ORDER BY ts ROWS 99 PRECEDING) >= 100 THEN (a - avg(a) OVER (ORDER BY ts ROWS 99 PRECEDING)) / stddev_pop(a) OVER (ORDER BY ts ROWS 99 PRECEDING) END')} AS zscore
FROM v""")
def _pair(t):
    panel = t.orders.groupBy(F.col("o_orderdate").alias("ts")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(
        F.avg("o_totalprice"))
    wide = panel.toDF("ts", "a", "b").dropna().withColumn("one", F.lit(1))
    p = Panel(wide, Series(keys=("one",), ts="ts", tie=()))
    X.rolling_corr(p, "a", "b", 100, "corr_100")
    X.zscore(p, "a", 100, "zscore", ddof=0)
    return rounded(p.done().select("ts", "corr_100", "zscore"))


@query("price_percentile", f"""WITH {TICKS}, l AS (
  SELECT symbol, tie, price, list(price) OVER ({TW} ROWS 99 PRECEDING) AS xs FROM ticks)
SELECT symbol, tie, {R('len(list_filter(xs, lambda x: x < price)) * 100.0 / len(xs)')} AS percentile FROM l""")
def _pct(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.price_percentile(p, "price", 100)
    return rounded(p.done().select("symbol", "tie", "percentile"))


@query("sma_cross", f"""WITH {TICKS}, s AS (SELECT symbol, tie, {roll('avg', 'price', 50, TW)} AS f,
  {roll('avg', 'price', 200, TW)} AS s FROM ticks)
SELECT symbol, tie, CASE WHEN s IS NULL THEN NULL WHEN {R('f - s', 9)} > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sma_cross FROM s""")
def _cross(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.sma_cross(p, 50, 200, "price")
    return p.done().select("symbol", "tie", F.col("sma_cross").cast("double").alias("sma_cross"))


@query("regimes", f"""WITH {RETURNS}, s AS (SELECT asset, ts, {roll('avg', 'ret', 20, AW)} AS mu,
  {roll('stddev_samp', 'ret', 20, AW)} AS sd FROM daily)
SELECT asset, ts, CASE WHEN sd IS NULL THEN NULL WHEN mu > 0.01 AND sd < 0.02 THEN 'bull'
  WHEN mu < -0.01 AND sd > 0.02 THEN 'bear' ELSE 'sideways' END AS regime FROM s""")
def _regime(t):
    p = Panel(t.daily_returns, RETURN_SERIES)
    X.regime(p, "ret")
    return p.done().select("asset", "ts", "regime")


WINS = (5, 10, 20, 50, 100)


@query("feature_windows", f"WITH {TICKS} SELECT symbol, tie, {R(f'coalesce(ln(price / lag(price) OVER ({TW})), 0)')} AS log_return, "
       f"{R(f'coalesce(volume / nullif(avg(volume) OVER ({TW} ROWS BETWEEN 199 PRECEDING AND 1 PRECEDING), 0), 1)')} AS volume_ratio, "
       + ", ".join(f"{R(roll('avg', 'price', n, TW))} AS sma_{n}, {R(roll('stddev_pop', 'price', n, TW))} AS std_{n}, "
                   f"{roll('max', 'price', n, TW)} AS max_{n}, {roll('min', 'price', n, TW)} AS min_{n}, "
                   f"{R(roll('avg', 'volume', n, TW))} AS volume_ma_{n}" for n in WINS) + " FROM ticks")
def _fw(t):
    p = Panel(t.ticks, TICK_SERIES)
    X.feature_windows(p, WINS)
    cols = [f"{k}_{n}" for n in WINS for k in ("sma", "std", "max", "min", "volume_ma")]
    return rounded(p.done().select("symbol", "tie", "log_return", "volume_ratio", *cols))


@query("count_windows", f"""WITH {TICKS}, i AS (SELECT *, row_number() OVER ({TW}) - 1 AS i FROM ticks),
w AS (SELECT *, unnest(range(CAST(greatest(ceil((i - 99) / 50), 0) AS BIGINT), CAST(floor(i / 50) + 1 AS BIGINT))) AS window_id FROM i)
SELECT symbol, window_id, {R('avg(price)')} AS avg_price, sum(volume) AS volume, min(ts) AS first_ts, max(ts) AS last_ts
FROM w GROUP BY 1, 2 HAVING count(*) = 100""")
def _cw(t):
    m = X.count_windows(t.ticks, TICK_SERIES, 100, 50)
    return rounded(X.complete_windows(m, TICK_SERIES, 100, F.avg("price").alias("avg_price"),
                                      F.sum("volume").alias("volume"), F.min("ts").alias("first_ts"),
                                      F.max("ts").alias("last_ts")), 6, "avg_price")


@query("newest_ticks_per_symbol", f"""WITH {TICKS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, tie DESC) AS rank FROM ticks)
SELECT symbol, tie, ts, price, rank FROM n WHERE rank <= 100""")
def _newest(t):
    return X.newest_per_key(t.ticks, TICK_SERIES, 100).select("symbol", "tie", "ts", "price", "rank")


@query("first_last_per_bucket", f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bucket,
  arg_min(price, (ts, tie)) AS first_price, arg_max(price, (ts, tie)) AS last_price FROM ticks GROUP BY 1, 2""")
def _firstlast(t):
    at = F.struct("ts", "tie")
    return t.ticks.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("bucket")).agg(
        F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"))


@query("time_gaps", f"""WITH {TICKS}, g AS (SELECT symbol, tie, ts, lag(ts) OVER ({TW}) AS prev_ts FROM ticks)
SELECT symbol, tie, prev_ts, epoch_us(ts - prev_ts) / 1e6 AS gap_seconds FROM g
WHERE epoch_us(ts - prev_ts) / 1e6 > 1800""")
def _gaps(t):
    return X.time_gaps(t.ticks, TICK_SERIES, 1800).select("symbol", "tie", "prev_ts", "gap_seconds")


@query("sessions_by_user", f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, tie)
    < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM ticks),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, tie) AS session_id FROM g)
SELECT user_id, CAST(session_id AS BIGINT) AS session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, {R('sum(price)', 4)} AS total
FROM n GROUP BY 1, 2""")
def _sessions(t):
    s = Series(keys=("user_id",), ts="ts", tie=("tie",))
    return X.sessions(t.ticks, s, "30 minutes").groupBy("user_id", "session_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"),
        rnd(F.sum("price"), 4).alias("total"))


@query("filled_gaps", f"""WITH {TICKS}, g AS (SELECT symbol, tie, ts, CASE WHEN volume > 50 THEN price END AS x FROM ticks)
SELECT symbol, tie, coalesce(last_value(x IGNORE NULLS) OVER ({TW}),
  first_value(x IGNORE NULLS) OVER ({TW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x FROM g""")
def _fill(t):
    g = t.ticks.withColumn("x", F.when(F.col("volume") > 50, F.col("price")))
    return X.fill_gaps(g, TICK_SERIES, ["x"]).select("symbol", "tie", "x")


@query("volume_by_price_quantile", f"""WITH {BARS}, q AS (
  SELECT symbol, quantile_cont(close, [{', '.join(str(k / 20) for k in range(1, 20))}]) AS qs FROM bars GROUP BY 1),
b AS (SELECT bars.*, CAST(len(list_filter(qs, lambda x: close > x + 1e-9)) AS INT) AS price_bucket FROM bars JOIN q USING (symbol))
SELECT symbol, ts, price_bucket, sum(volume) OVER (PARTITION BY symbol, price_bucket) AS poc FROM b""")
def _poc(t):
    return X.volume_by_price_quantile(t.bars).select("symbol", "ts", "price_bucket", "poc")
