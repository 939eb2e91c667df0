"""Risk, returns and portfolios over the daily return panel."""

from statistics import NormalDist

from pyspark.sql import functions as F

from quotemill.operators import portfolio as P
from quotemill.operators import risk as K
from quotemill.operators import rolling as X
from quotemill.operators import stats as A
from quotemill.operators.ordered import Panel
from quotemill.plans.aggregate_queries import ASSETS, POSITIONS, WIDE, positions_view, wide_returns
from quotemill.plans.market import BAR_SERIES, BARS, QUOTES, RETURN_SERIES, RETURNS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rnd, rounded
from quotemill.plans.rolling_queries import AW, BW, TW, roll

Z95 = NormalDist().inv_cdf(0.05)
WEIGHTS = [0.4, 0.3, 0.1, 0.1, 0.1]
W_SQL = ", weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in zip(ASSETS, WEIGHTS)) + ") v(asset, weight))"
PORT = RETURNS + W_SQL + ", port AS (SELECT ts, sum(weight * ret) AS p FROM daily JOIN weights USING (asset) GROUP BY ts HAVING count(*) = 5)"


def weights(t):
    return t.spark.createDataFrame(list(zip(ASSETS, WEIGHTS)), "asset string, weight double")


@query("historical_var", f"WITH {RETURNS} SELECT asset, {R('quantile_cont(ret, 0.05)')} AS var_95, {R('quantile_cont(ret, 0.01)')} AS var_99 FROM daily GROUP BY 1")
def _hvar(t):
    d = t.daily_returns
    return rounded(K.historical_var(d, out="var_95").join(K.historical_var(d, confidence=0.99, out="var_99"), "asset"))


@query("gaussian_var", f"WITH {RETURNS} SELECT asset, {R(f'avg(ret) + ({Z95!r}) * stddev_samp(ret)')} AS var FROM daily GROUP BY 1")
def _gvar(t):
    return rounded(K.gaussian_var(t.daily_returns))


@query("student_var")
def _tvar(t):
    return rounded(K.student_var(t.daily_returns))


TAIL = ", ".join(f"avg(ret) FILTER (ret <= q{p} + 1e-12) AS c{p}" for p in (1, 5, 10))


@query("expected_shortfall", f"""WITH {RETURNS}, q AS (SELECT asset, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.1) AS q10 FROM daily GROUP BY 1),
c AS (SELECT asset, {TAIL} FROM daily JOIN q USING (asset) GROUP BY 1) SELECT asset, {R('c1')} AS cvar_1, {R('c5')} AS cvar_5, {R('c10')} AS cvar_10 FROM c""")
def _cvar(t):
    return rounded(K.expected_shortfall(t.daily_returns, levels=(0.01, 0.05, 0.10)))


def draw_sql(seed: int, *parts: str) -> str:
    """The twin of ``uniform_draw``."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((CAST('0x' || substring(md5({text}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r})"


@query("monte_carlo_var", f"""WITH {RETURNS}, s AS (SELECT asset, avg(ret) AS m, stddev_samp(ret) AS sd FROM daily GROUP BY 1), d AS (SELECT *, unnest(range(1, 10001)) AS draw FROM s),
x AS (SELECT asset, m + sd * sqrt(-2 * ln({draw_sql(7, 'asset', 'draw', "'u'")})) * cos(2 * pi() * {draw_sql(7, 'asset', 'draw', "'v'")}) AS x FROM d)
SELECT asset, {R('quantile_cont(x, 0.05)')} AS var FROM x GROUP BY 1""")
def _mc(t):
    return rounded(K.monte_carlo_var(t.daily_returns))


@query("portfolio_var", f"WITH {PORT} SELECT {R('quantile_cont(p, 0.05)')} AS historical, {R(f'avg(p) + ({Z95!r}) * stddev_samp(p)')} AS gaussian FROM port")
def _pvar(t):
    p = K.portfolio_returns(t.daily_returns, weights(t)).withColumn("k", F.lit("all"))
    h = K.historical_var(p, ["k"], out="historical").join(K.gaussian_var(p, ["k"]).withColumnRenamed("var", "gaussian"), "k")
    return rounded(h.drop("k"))


@query("var_contributions", f"""WITH {PORT}, c AS (SELECT asset, -({Z95!r}) * corr(ret, p) * stddev_samp(ret) / stddev_samp(p) AS m FROM daily JOIN port USING (ts) GROUP BY 1)
SELECT asset, {R('m')} AS marginal_var, {R('weight * m')} AS component_var, {R('0.05 * m')} AS incremental_var FROM c JOIN weights USING (asset)""")
def _contrib(t):
    return rounded(K.var_contributions(t.daily_returns, weights(t), change=0.05))


PERF = f"""eq AS (SELECT asset, ts, ret, exp(sum(ln(1 + ret)) OVER ({AW})) AS equity FROM daily),
dd AS (SELECT *, equity / max(equity) OVER ({AW}) - 1 AS drawdown FROM eq),
pf AS (SELECT asset, count(*) AS periods, sum(ln(1 + ret)) AS log_total, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS annual_return, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) AS mean,
  stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, min(drawdown) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM dd GROUP BY 1)"""


@query("performance", f"""WITH {RETURNS}, {PERF} SELECT asset, periods, {R('annual_return')} AS annual_return, {R('volatility')} AS volatility, {R('annual_return / volatility')} AS sharpe,
  {R('mean * 252 / volatility')} AS sharpe_arithmetic, {R('annual_return / down')} AS sortino, {R('annual_return / abs(max_drawdown)')} AS calmar, {R('max_drawdown')} AS max_drawdown, {R('win_rate')} AS win_rate,
  {R('skew')} AS skew, {R('kurtosis')} AS kurtosis FROM pf""")
def _perf(t):
    p = K.performance(t.daily_returns, RETURN_SERIES)
    return rounded(p.select("asset", "periods", "annual_return", "volatility", "sharpe", "sharpe_arithmetic", "sortino", "calmar", "max_drawdown", "win_rate", "skew", "kurtosis"))


def significant(expr: str, digits: int = 6) -> str:
    """Rounding to significant digits, for both engines."""
    unit = f"power(10.0, {digits - 1} - floor(log10(abs({expr}))))"
    return f"CASE WHEN ({expr}) = 0 THEN 0.0 ELSE floor(({expr}) * {unit} + 0.4871) / {unit} END"


@query("relative_performance", f"""WITH {RETURNS}, m AS (SELECT ts, avg(ret) AS bench FROM daily GROUP BY 1),
r AS (SELECT asset, covar_samp(ret, bench) / var_samp(bench) AS beta, stddev_samp(ret - bench) * sqrt(252) AS te, avg(ret - bench) AS act,
  exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS own, exp(sum(ln(1 + bench)) * 252 / count(*)) - 1 AS b FROM daily JOIN m USING (ts) GROUP BY 1)
SELECT asset, {R('beta')} AS beta, {R('te')} AS tracking_error, {significant('own - beta * b')} AS alpha, {R('act * 252 / te')} AS information_ratio FROM r""")
def _rel(t):
    d = t.daily_returns
    out = K.relative_performance(d, d.groupBy("ts").agg(F.avg("ret").alias("bench")))
    out = rounded(out, 6, "beta", "tracking_error", "information_ratio")
    return out.withColumn("alpha", F.expr(significant("alpha")))  # compounded daily swings: of any size


@query("portfolio_metrics", f"WITH {PORT} SELECT {R('avg(p) * 252')} AS expected_return, {R('stddev_samp(p) * sqrt(252)')} AS volatility, {R('sqrt(252) * avg(p) / stddev_samp(p)')} AS sharpe_ratio, {R('skewness(p)')} AS skewness, {R('kurtosis(p)')} AS kurtosis, 5 AS num_assets FROM port")
def _pmetrics(t):
    p = K.portfolio_returns(t.daily_returns, weights(t))
    return rounded(p.agg((F.avg("ret") * 252).alias("expected_return"), (F.stddev_samp("ret") * K.ROOT).alias("volatility"),
                         (F.avg("ret") / F.stddev_samp("ret") * K.ROOT).alias("sharpe_ratio"), A.sample_skew("ret").alias("skewness"),
                         A.sample_kurtosis("ret").alias("kurtosis"), F.lit(5).alias("num_assets")))


@query("risk_report", f"""WITH {RETURNS}, {PERF}, q AS (SELECT asset, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.1) AS q10 FROM daily GROUP BY 1),
c AS (SELECT asset, {TAIL}, any_value(q5) AS var_95, avg(ret) FILTER (ret > 0) AS gain FROM daily JOIN q USING (asset) GROUP BY 1)
SELECT asset, {R('volatility')} AS volatility, {R('max_drawdown')} AS max_drawdown, {R('var_95')} AS var_95, {R('c5')} AS cvar_5, {R('c10')} AS cvar_10, {R('win_rate')} AS win_rate,
  {R('greatest(0, least(win_rate - (1 - win_rate) / abs(c5 / gain), 1))')} AS kelly_fraction FROM pf JOIN c USING (asset)""")
def _report(t):
    r = K.risk_report(t.daily_returns, RETURN_SERIES)
    return rounded(r.select("asset", "volatility", "max_drawdown", "var_95", "cvar_5", "cvar_10", "win_rate", "kelly_fraction"))


SCEN = {"crash": ("ret * 1.5 - 0.01", lambda r: r * 1.5 - 0.01), "calm": ("ret * 0.5", lambda r: r * 0.5), "drift": ("ret + 0.001", lambda r: r + 0.001)}


@query("stress_scenarios", f"""WITH {RETURNS}, s AS ({' UNION ALL '.join(f"SELECT asset, ts, '{n}' AS scenario, {e[0]} AS r FROM daily" for n, e in SCEN.items())}),
e AS (SELECT *, sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END) OVER w AS lw, coalesce(bool_or(r <= -1) OVER w, false) AS dead, row_number() OVER w AS i
  FROM s WINDOW w AS (PARTITION BY asset, scenario ORDER BY ts)),
p AS (SELECT *, max(CASE WHEN NOT dead THEN {{'l': round(lw, 9), 'i': i}} END) OVER (PARTITION BY asset, scenario ORDER BY ts) AS top,
  max(CASE WHEN NOT dead THEN lw END) OVER (PARTITION BY asset, scenario ORDER BY ts) AS best FROM e),
d AS (SELECT *, CASE WHEN dead THEN -1 ELSE exp(lw - best) - 1 END AS dd, i - coalesce(top.i, 0) AS under FROM p)
SELECT asset, scenario, {R('min(dd)')} AS max_drawdown, {R('min(r)')} AS min_return, max(under) AS longest_recovery, arg_max(under, ts) AS open_recovery FROM d GROUP BY 1, 2""")
def _stress(t):
    out = K.stress(t.daily_returns, RETURN_SERIES, {n: e[1](F.col("ret")) for n, e in SCEN.items()})
    return rounded(out.select("asset", "scenario", "max_drawdown", "min_return", "longest_recovery", "open_recovery"))


@query("inverse_volatility_weights", f"WITH {RETURNS}, v AS (SELECT asset, stddev_samp(ret) AS vol, avg(ret) - 0.1 AS signal FROM daily GROUP BY 1), i AS (SELECT *, CASE WHEN signal > 0 THEN 1 / vol ELSE 0 END AS inv FROM v) SELECT asset, {R('coalesce(inv / nullif(sum(inv) OVER (), 0), 0)')} AS weight FROM i")
def _invvol(t):
    v = t.daily_returns.groupBy("asset").agg(F.stddev_samp("ret").alias("volatility"), (F.avg("ret") - 0.1).alias("signal"))
    return rounded(P.inverse_volatility(v).select("asset", "weight"))


BOOK = POSITIONS + ", bk AS (SELECT portfolio, symbol, CASE WHEN symbol < '3' THEN 'high' ELSE 'low' END AS sector, quantity / sum(quantity) OVER (PARTITION BY portfolio) AS weight FROM pos)"


@query("limit_checks", f"""WITH {BOOK}, x AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY portfolio) AS lev, sum(abs(weight)) OVER (PARTITION BY portfolio, sector) AS sw FROM bk)
SELECT portfolio, symbol, CASE WHEN weight > 0.2 THEN 'max_weight' WHEN weight < -0.2 THEN 'min_weight' ELSE 'ok' END AS weight_check, lev <= 5 AS leverage_ok, sw <= 0.4 AS sector_ok,
  weight <= 0.2 AND weight >= -0.2 AND lev <= 5 AND sw <= 0.4 AS passed FROM x""")
def _limits(t):
    pos, _ = positions_view(t)
    total = pos.groupBy("portfolio").agg(F.sum("quantity").alias("total"))
    book = pos.join(total, "portfolio").select("portfolio", "symbol", F.when(F.col("symbol") < "3", "high").otherwise("low").alias("sector"), (F.col("quantity") / F.col("total")).alias("weight"))
    return P.limit_checks(book).select("portfolio", "symbol", "weight_check", "leverage_ok", "sector_ok", "passed")


@query("correlation_limit", f"WITH {WIDE}{W_SQL}, cv AS (" + " UNION ALL ".join(
    f"SELECT '{ASSETS[i]}' AS a, '{ASSETS[j]}' AS b, covar_samp(a{i}, a{j}) AS cov FROM wide" for i in range(5) for j in range(5))
    + f"""), s AS (SELECT cv.a, sum(cov * weight) AS sw FROM cv JOIN weights w ON w.asset = cv.b GROUP BY 1),
v AS (SELECT s.a, sw, weight, sum(weight * sw) OVER () AS total FROM s JOIN weights w ON w.asset = s.a),
k AS (SELECT v.a, weight, sw / sqrt(cov * total) AS r FROM v JOIN cv ON cv.a = v.a AND cv.b = v.a)
SELECT a AS symbol, {R('r')} AS correlation, abs(r) <= 0.45 AS correlation_ok, weight <= 0.5 AND weight >= -0.5 AND abs(r) <= 0.45 AS passed FROM k""")
def _correlation_limit(t):
    """Positions whose returns are too much like those of the whole portfolio."""
    book = weights(t).select(F.lit("p").alias("portfolio"), F.col("asset").alias("symbol"), F.lit("all").alias("sector"), "weight")
    like = P.portfolio_correlations(book, A.covariance_matrix(wide_returns(t), ASSETS, 1))
    out = P.limit_checks(book, max_weight=0.5, max_sector=5.0, correlations=like, max_correlation=0.45)
    return rounded(out.select("symbol", "correlation", "correlation_ok", "passed"))


@query("drawdown_limit", f"WITH {RETURNS}, {PERF} SELECT asset, ts, (1 - (drawdown + 1)) <= 0.5 AS within FROM dd")
def _ddlimit(t):
    e = X.equity_curve(t.daily_returns, RETURN_SERIES)
    return e.select("asset", "ts", P.drawdown_ok(F.col("equity"), F.col("peak"), 0.5).alias("within"))


@query("exit_levels", f"""WITH {QUOTES}, o AS (SELECT tie, price, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM ticks)
SELECT tie, {R("price * CASE WHEN side = 'buy' THEN 0.95 ELSE 1.05 END")} AS stop_loss, {R("price * CASE WHEN side = 'buy' THEN 1.1 ELSE 0.9 END")} AS take_profit FROM o""")
def _exits(t):
    d = t.ticks.withColumn("side", F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell")).withColumnRenamed("price", "entry_price")
    return rounded(d.select("tie", *[v.alias(k) for k, v in P.exit_levels().items()]))


@query("exit_status", f"WITH {POSITIONS} SELECT portfolio, symbol, CASE WHEN (last_price - entry_price) / entry_price <= -0.05 THEN 'STOP_LOSS' WHEN (last_price - entry_price) / entry_price >= 0.1 THEN 'TAKE_PROFIT' ELSE 'OK' END AS status FROM pos JOIN px USING (symbol)")
def _status(t):
    pos, px = positions_view(t)
    return pos.join(px, "symbol").select("portfolio", "symbol", P.exit_status(F.col("last_price"), F.col("entry_price")).alias("status"))


@query("stop_loss_triggers", f"""WITH {QUOTES}, o AS (SELECT tie AS order_id, symbol, ts, price * 0.7 AS stop FROM ticks WHERE volume > 85)
SELECT o.order_id, o.symbol, min(q.ts) AS trigger_ts FROM o JOIN quotes q ON q.symbol = o.symbol AND q.ts >= o.ts AND q.bid <= o.stop GROUP BY 1, 2""")
def _stops(t):
    from quotemill.operators.joins import first_trigger

    o = t.ticks.filter("volume > 85").select(F.col("tie").alias("order_id"), "symbol", "ts", (F.col("price") * 0.7).alias("stop"))
    return first_trigger(o, t.quotes, TICK_SERIES, "order_id", "stop", F.col("bid")).select("order_id", "symbol", "trigger_ts")


@query("position_book", f"""WITH RECURSIVE {TICKS}, tr AS MATERIALIZED (SELECT symbol, tie, price, CASE WHEN user_id % 5 < 3 THEN volume ELSE -volume * 1.5 END AS d, row_number() OVER ({TW}) AS rn FROM ticks WHERE volume > 0),
k AS (SELECT symbol, tie, rn, price, greatest(d, 0)::DOUBLE AS held, (CASE WHEN d > 0 THEN price ELSE 0 END)::DOUBLE AS entry, 0::DOUBLE AS realized, d < 0 AS oversold FROM tr WHERE rn = 1
 UNION ALL SELECT t.symbol, t.tie, t.rn, t.price, greatest(k.held + t.d, 0),
   CASE WHEN t.d > 0 THEN (k.held * k.entry + t.d * t.price) / (k.held + t.d) WHEN k.held + t.d <= 0 THEN 0 ELSE k.entry END,
   k.realized + CASE WHEN t.d < 0 THEN least(-t.d, k.held) * (t.price - k.entry) ELSE 0 END, t.d < -k.held
 FROM k JOIN tr t ON t.symbol = k.symbol AND t.rn = k.rn + 1)
SELECT symbol, tie, held, {R('entry', 5)} AS entry_price, {R('realized', 3)} AS realized_pnl, {R('held * (price - entry)', 3)} AS unrealized_pnl, oversold FROM k""")
def _positions(t):
    d = F.when(F.col("user_id") % 5 < 3, F.col("volume")).otherwise(F.col("volume") * 1.5)
    trades = t.ticks.filter("volume > 0").select("symbol", "ts", "tie", "price", d.alias("quantity"), F.when(F.col("user_id") % 5 < 3, "buy").otherwise("sell").alias("side"))
    out = P.positions(trades, TICK_SERIES).select("symbol", "tie", "held", "entry_price", "realized_pnl", "unrealized_pnl", "oversold")
    return rounded(rounded(out, 5, "entry_price"), 3, "realized_pnl", "unrealized_pnl")


@query("rebalance_orders", f"""WITH {POSITIONS}, v AS (SELECT *, quantity * last_price AS val, sum(quantity * last_price) OVER (PARTITION BY portfolio) AS total FROM pos JOIN px USING (symbol)),
t AS (SELECT portfolio, any_value(total) AS total FROM v GROUP BY 1), g AS (SELECT t.portfolio, px.symbol, px.last_price, t.total * 0.2 - coalesce(v.val, 0) AS diff FROM t CROSS JOIN px LEFT JOIN v ON v.portfolio = t.portfolio AND v.symbol = px.symbol)
SELECT portfolio, symbol, CASE WHEN diff > 0 THEN 'buy' ELSE 'sell' END AS side, {R('abs(diff) / last_price', 4)} AS quantity FROM g WHERE abs(diff) >= 1e-6""")
def _rebalance(t):
    pos, px = positions_view(t)
    targets = pos.select("portfolio").distinct().withColumn("symbol", F.explode(F.array(*[F.lit(a) for a in ASSETS]))).withColumn("target_weight", F.lit(0.2))
    return rounded(P.rebalance(pos, targets, px), 4, "quantity")


@query("risk_contributions", f"WITH {WIDE}{W_SQL}, cv AS (" + " UNION ALL ".join(
    f"SELECT '{ASSETS[i]}' AS a, '{ASSETS[j]}' AS b, covar_samp(a{i}, a{j}) AS cov FROM wide" for i in range(5) for j in range(5))
    + f"), s AS (SELECT cv.a, sum(cov * weight) AS sw FROM cv JOIN weights w ON w.asset = cv.b GROUP BY 1), p AS (SELECT s.a, weight * sw AS part FROM s JOIN weights w ON w.asset = s.a) SELECT a AS asset, {R('part / sum(part) OVER ()')} AS contribution FROM p")
def _rc(t):
    return rounded(P.risk_contributions(A.covariance_matrix(wide_returns(t), ASSETS), weights(t)))


@query("random_portfolios", f"""WITH {WIDE}, mo AS (SELECT {', '.join(f'avg(a{i}) * 252 AS m{i}' for i in range(5))}, {', '.join(f'covar_samp(a{i}, a{j}) * 252 AS c{i}{j}' for i in range(5) for j in range(5))} FROM wide),
e AS (SELECT draw, {', '.join(f"-ln({draw_sql(11, 'draw', str(i))}) AS e{i}" for i in range(5))} FROM (SELECT unnest(range(1000)) AS draw)),
w AS (SELECT draw, {', '.join(f'e{i} / (e0 + e1 + e2 + e3 + e4) AS w{i}' for i in range(5))} FROM e),
p AS (SELECT w.*, {' + '.join(f'w{i} * m{i}' for i in range(5))} AS ret, sqrt({' + '.join(f'w{i} * w{j} * c{i}{j}' for i in range(5) for j in range(5))}) AS vol FROM w, mo)
SELECT draw, {', '.join(f'{R(f"w{i}")} AS "{a}"' for i, a in enumerate(ASSETS))}, {R('ret')} AS ret, {R('vol')} AS vol, {R('(ret - 0.02) / (vol + 1e-9)')} AS sharpe FROM p""")
def _frontier(t):
    return rounded(P.random_portfolios(t.spark, wide_returns(t), ASSETS))


@query("optimal_weights")
def _optimal(t):
    wide = wide_returns(t)
    out = None
    for m in ("min_variance", "mean_variance", "hierarchical", "cvar"):
        w = P.optimal_weights(t.spark, wide, ASSETS, m).withColumn("method", F.lit(m))
        out = w if out is None else out.unionByName(w)
    return out


@query("signal_returns", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN {roll('avg', 'close', 5, BW)} > {roll('avg', 'close', 20, BW)} THEN 1 ELSE 0 END AS sig FROM bars),
p AS (SELECT *, coalesce(lag(sig) OVER ({BW}), 0) AS pos, coalesce(lag(sig, 2) OVER ({BW}), 0) AS was FROM s),
r AS (SELECT symbol, ts, coalesce(close / lag(close) OVER ({BW}) - 1, 0) * pos - abs(pos - was) * 0.0015 AS sr FROM p)
SELECT symbol, ts, {R('sr')} AS strategy_ret, CASE WHEN bool_or(sr <= -1) OVER ({BW}) THEN NULL ELSE {R(f'sum(CASE WHEN sr > -1 THEN ln(1 + sr) END) OVER ({BW})')} END AS log_equity FROM r""")
def _signal_returns(t):
    p = Panel(t.bars, BAR_SERIES)
    a, b = p.mean("_f", "close", 5), p.mean("_s", "close", 20)
    sig = p.temp("_sig", F.when(F.round(F.col(a) - F.col(b), 9) > 0, 1).otherwise(0), [a, b])
    P.signal_returns(p, sig)
    e = X.equity_curve(p.done(), BAR_SERIES, "strategy_ret")
    return e.select("symbol", "ts", rnd("strategy_ret").alias("strategy_ret"), rnd(F.when(F.col("equity") > 0, F.log("equity"))).alias("log_equity"))


@query("backtest_trades", f"""WITH {BARS}, s AS (SELECT symbol, ts, close, CASE WHEN round({roll('avg', 'close', 5, BW)} - {roll('avg', 'close', 20, BW)}, 9) > 0 THEN 1 WHEN round({roll('avg', 'close', 5, BW)} - {roll('avg', 'close', 20, BW)}, 9) < 0 THEN -1 ELSE 0 END AS sig FROM bars),
b AS (SELECT *, CASE WHEN lag(sig) OVER ({BW}) IS NULL OR lag(sig) OVER ({BW}) <> sig THEN 1 ELSE 0 END AS begins, lead(close) OVER ({BW}) AS after, lead(ts) OVER ({BW}) AS after_ts FROM s),
r AS (SELECT *, sum(begins) OVER ({BW}) AS run FROM b),
g AS (SELECT symbol, run, any_value(sig) AS side, min(ts) AS entry_ts, arg_min(close, ts) AS entry_price, count(*) AS rows, max(ts) AS last_ts, arg_max(close, ts) AS last_price FROM r WHERE sig <> 0 GROUP BY 1, 2),
e AS (SELECT g.*, r.after, r.after_ts FROM g JOIN r ON r.symbol = g.symbol AND r.ts = g.last_ts)
SELECT symbol, CAST(run AS BIGINT) AS trade, side, entry_ts, coalesce(after_ts, last_ts) AS exit_ts, {R('entry_price')} AS entry_price, {R('coalesce(after, last_price)')} AS exit_price, rows,
  {R('(side * (coalesce(after, last_price) / entry_price - 1) - CASE WHEN after_ts IS NULL THEN 0.0015 ELSE 0.003 END) * 100')} AS return_pct, CASE WHEN after_ts IS NULL THEN 'open' ELSE 'closed' END AS status FROM e""")
def _trades(t):
    """Round trips of a moving-average crossover, long and short."""
    p = Panel(t.bars, BAR_SERIES)
    a, b = p.mean("_f", "close", 5), p.mean("_s", "close", 20)
    apart = F.round(F.col(a) - F.col(b), 9)
    p.add("sig", F.when(apart > 0, 1).when(apart < 0, -1).otherwise(0), [a, b])
    return rounded(P.backtest_trades(p.done(), BAR_SERIES, "sig"), 6, "entry_price", "exit_price", "return_pct")


GRID = [(f, s) for f in (3, 5, 10) for s in (20, 40, 60)]
FOLDS = """, z AS (SELECT *, floor((row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) * 4 / count(*) OVER (PARTITION BY symbol)) AS fold, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS past FROM bars)"""


def _trial(fast: int, slow: int) -> str:
    return f"""SELECT {fast} AS fast, {slow} AS slow, symbol, ts, fold, close, past,
  CASE WHEN {roll('avg', 'close', fast, BW)} > {roll('avg', 'close', slow, BW)} THEN 1 ELSE 0 END AS sig FROM z"""


@query("crossover_search", f"""WITH {BARS}{FOLDS}, g AS ({' UNION ALL '.join(_trial(f, s) for f, s in GRID)}),
p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos, coalesce(lag(sig, 2) OVER w, 0) AS was FROM g WINDOW w AS (PARTITION BY fast, slow, symbol ORDER BY ts)),
r AS (SELECT *, coalesce(close / past - 1, 0) * pos - abs(pos - was) * 0.0015 AS ret FROM p),
f AS (SELECT fast, slow, symbol, fold, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe,
  CASE WHEN min(ret) <= -1 THEN -1 ELSE exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END)) - 1 END AS total FROM r GROUP BY 1, 2, 3, 4)
SELECT fast, slow, {R('avg(sharpe)')} AS mean_sharpe, {significant('avg(total)')} AS mean_return FROM f GROUP BY 1, 2""")
def _search(t):
    out = rounded(P.crossover_search(t.bars, BAR_SERIES, GRID), 6, "mean_sharpe")
    return out.withColumn("mean_return", F.expr(significant("mean_return")))


@query("regime_position_size", f"""WITH {RETURNS}, s AS (SELECT asset, ts, {roll('avg', 'ret', 20, AW)} AS mu, {roll('stddev_samp', 'ret', 20, AW)} AS sd FROM daily),
g AS (SELECT asset, ts, CASE WHEN sd IS NULL THEN NULL WHEN mu > 0.01 AND sd < 0.02 THEN 'bull' WHEN mu < -0.01 AND sd > 0.02 THEN 'bear' ELSE 'sideways' END AS regime FROM s)
SELECT asset, ts, {R("CASE regime WHEN 'bull' THEN 0.1 WHEN 'sideways' THEN 0.05 WHEN 'bear' THEN 0.02 ELSE 0.01 END")} AS size FROM g""")
def _size(t):
    p = Panel(t.daily_returns, RETURN_SERIES)
    X.regime(p, "ret")
    return p.done().select("asset", "ts", rnd(K.regime_size()).alias("size"))
