"""Order books, order flow, venues and pairs."""

from pyspark.sql import functions as F

from quotemill.functions.special import COINTEGRATION_CRITICAL, UNIT_ROOT
from quotemill.operators import micro as M
from quotemill.operators import pairs as P
from quotemill.operators.ordered import Panel
from quotemill.plans.aggregate_queries import ASSETS
from quotemill.plans.market import QUOTES, RETURNS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, normal_tails, query, rounded
from quotemill.plans.rolling_queries import TW

DELTAS = TICKS + """, arrivals AS (SELECT symbol, ts, tie, CASE WHEN volume >= 95 THEN tie - 50 ELSE tie END AS sequence,
  CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, price, CASE WHEN volume < 20 THEN 0 ELSE volume END AS size FROM ticks),
deltas AS (SELECT * FROM (SELECT *, max(sequence) OVER (""" + TW + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM arrivals) WHERE top IS NULL OR sequence > top),
levels AS (SELECT symbol, side, round(price / 0.5) * 0.5 AS price, arg_max(size, sequence) AS size, count(*) AS updates FROM deltas GROUP BY 1, 2, 3),
book AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM levels WHERE size > 0 QUALIFY level <= 10)"""


def deltas(t):
    """Every tick is a level update; large ones arrive with an old sequence number and small ones empty the level."""
    return t.ticks.select(
        "symbol", "ts", "tie", F.when(F.col("volume") >= 95, F.col("tie") - 50).otherwise(F.col("tie")).alias("sequence"),
        F.when(F.col("user_id") % 2 == 0, "bid").otherwise("ask").alias("side"), "price",
        F.when(F.col("volume") < 20, 0.0).otherwise(F.col("volume")).alias("size"))


def book(t):
    return M.book_state(M.drop_stale(deltas(t), TICK_SERIES), 0.5, 10)


@query("stale_updates_dropped", f"WITH {DELTAS} SELECT symbol, tie, sequence FROM deltas")
def _stale(t):
    return M.drop_stale(deltas(t), TICK_SERIES).select("symbol", "tie", "sequence")


@query("book_state", f"WITH {DELTAS} SELECT symbol, side, price, size, updates, CAST(level AS INT) AS level FROM book")
def _book(t):
    return book(t).select("symbol", "side", "price", "size", "updates", "level")


@query("book_snapshot_record", f"""WITH {DELTAS}, s AS (SELECT symbol, max(price) FILTER (side = 'bid') AS bp, min(price) FILTER (side = 'ask') AS ap,
  arg_max(size, price) FILTER (side = 'bid') AS bs, arg_min(size, price) FILTER (side = 'ask') AS az,
  sum(size) FILTER (side = 'bid' AND level <= 5) AS b5, sum(size) FILTER (side = 'ask' AND level <= 5) AS a5 FROM book GROUP BY 1)
SELECT symbol, {R('(bp + ap) / 2')} AS mid, {R('ap - bp')} AS spread, {R('(bp * az + ap * bs) / (bs + az)')} AS weighted_mid, {R('(b5 - a5) / (b5 + a5)')} AS imbalance FROM s""")
def _record(t):
    s = M.snapshots(book(t))
    rec = M.snapshot_record(0.5, 300.0)
    return rounded(s.select("symbol", *[rec[k].alias(k) for k in ("mid", "spread", "weighted_mid", "imbalance")]))


@query("book_walk_cost", f"""WITH {DELTAS}, w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY symbol, side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM book),
f AS (SELECT *, greatest(least(size, 300 - before), 0) AS take FROM w),
a AS (SELECT symbol, side, sum(take * price) / sum(take) AS vwap, arg_min(price, level) AS best FROM f GROUP BY 1, 2)
SELECT symbol, {R("max(CASE WHEN side = 'ask' THEN (vwap - best) / 0.5 END)")} AS buy_impact, {R("max(CASE WHEN side = 'bid' THEN (best - vwap) / 0.5 END)")} AS sell_impact FROM a GROUP BY 1""")
def _walk(t):
    s = M.snapshots(book(t))
    size = F.lit(300.0)
    return rounded(s.select("symbol", M.walk_cost("asks", size, 0.5, True).alias("buy_impact"), M.walk_cost("bids", size, 0.5, False).alias("sell_impact")))


LEVELS = QUOTES + """, lv AS (SELECT q.tie, q.symbol, q.ts, j, t.price * (1 - j / 1000.0) AS bp, t.price * (1 + j / 1000.0) AS ap, t.volume + j AS bs, 100 - t.volume + j AS az
  FROM quotes q JOIN ticks t USING (tie), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS j))"""


def level_books(t):
    """Six levels around every tick, best first."""
    js = F.array(*[F.lit(j) for j in range(1, 7)])
    def side(sign, base):
        return F.transform(js, lambda j: F.struct((F.col("price") * (1 + sign * j / 1000.0)).alias("price"), (base + j).cast("double").alias("size")))
    return t.ticks.select("tie", "symbol", "ts", side(-1, F.col("volume")).alias("bids"), side(1, 100 - F.col("volume")).alias("asks"))


@query("book_features", f"""WITH {LEVELS}, a AS (SELECT tie, any_value(symbol) AS symbol, max(bp) AS b0, min(ap) AS a0, sum(bs) AS tb, sum(az) AS ta,
    sum(bs * bp) AS sbp, sum(az * ap) AS sap FROM lv GROUP BY 1)
SELECT tie, {R('a0 - b0')} AS spread, {R('(a0 + b0) / 2')} AS mid_price, {R('(tb - ta) / (tb + ta + 1e-10)')} AS ob_imbalance,
  {R('(b0 - sbp / tb) / (b0 + 1e-10)')} AS bid_slope, {R('(sap / ta - a0) / (a0 + 1e-10)')} AS ask_slope, CAST(tb AS DOUBLE) AS total_bid, CAST(ta AS DOUBLE) AS total_ask FROM a""")
def _features(t):
    f = M.book_features()
    return rounded(level_books(t).select("tie", *[v.alias(k) for k, v in f.items()]), 6, "spread", "mid_price", "ob_imbalance", "bid_slope", "ask_slope")


@query("top_depth", f"WITH {LEVELS} SELECT tie, CAST(sum(bs) FILTER (j <= 3) AS DOUBLE) AS bid_depth, CAST(sum(az) FILTER (j <= 3) AS DOUBLE) AS ask_depth FROM lv GROUP BY 1")
def _depth(t):
    return level_books(t).select("tie", M.sizes("bids", 3).alias("bid_depth"), M.sizes("asks", 3).alias("ask_depth"))


@query("order_flow", f"""WITH {TICKS}, f AS (SELECT *, sum(CASE WHEN user_id % 2 = 0 THEN volume ELSE 0 END) OVER w AS b, sum(CASE WHEN user_id % 2 = 1 THEN volume ELSE 0 END) OVER w AS s
  FROM ticks WINDOW w AS ({TW} ROWS 99 PRECEDING))
SELECT tie, symbol, {R('coalesce((b - s) / nullif(b + s, 0), 0)')} AS order_flow_imbalance, {R('abs(coalesce((b - s) / nullif(b + s, 0), 0))')} AS toxicity FROM f""")
def _flow(t):
    p = Panel(t.ticks.withColumn("is_buy", F.col("user_id") % 2 == 0), TICK_SERIES)
    M.flow(p, 100)
    return rounded(p.done().select("tie", "symbol", "order_flow_imbalance", "toxicity"))


@query("rolling_book_imbalance", f"""WITH {LEVELS}, a AS (SELECT tie, symbol, ts, sum(bs) FILTER (j <= 5) AS b, sum(az) FILTER (j <= 5) AS s FROM lv GROUP BY 1, 2, 3),
w AS (SELECT tie, symbol, sum(b) OVER w AS b, sum(s) OVER w AS s FROM a WINDOW w AS ({TW} ROWS 99 PRECEDING))
SELECT tie, symbol, {R('coalesce((b - s) / nullif(b + s, 0), 0)')} AS book_imbalance FROM w""")
def _rbi(t):
    b = level_books(t).select("tie", "symbol", "ts", M.sizes("bids", 5).alias("bid_volume"), M.sizes("asks", 5).alias("ask_volume"))
    p = Panel(b, TICK_SERIES)
    M.rolling_book_imbalance(p, 100)
    return rounded(p.done().select("tie", "symbol", "book_imbalance"))


@query("triangular_arbitrage", f"""WITH {QUOTES}, tops AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS hour, max(bid) / 50 AS bid, min(ask) / 50 AS ask FROM quotes GROUP BY 1, 2),
j AS (SELECT b.hour, b.symbol AS base, q.symbol AS quote, b.bid * q.bid AS synthetic_bid, b.ask * q.ask AS synthetic_ask FROM tops b JOIN tops q USING (hour)
  WHERE (b.symbol, q.symbol) IN (('click', 'view'), ('click', 'error'), ('purchase', 'signup')))
SELECT hour, base, quote, {R('synthetic_bid')} AS synthetic_bid, {R('synthetic_ask')} AS synthetic_ask, {R('synthetic_bid / synthetic_ask - 1', 4)} AS edge FROM j WHERE synthetic_bid > 1.001 * synthetic_ask""")
def _triangular(t):
    tops = t.quotes.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("hour")).agg((F.max("bid") / 50).alias("bid"), (F.min("ask") / 50).alias("ask"))
    pairs = t.spark.createDataFrame([("click", "view"), ("click", "error"), ("purchase", "signup")], "base string, quote string")
    return rounded(rounded(M.triangular(tops, pairs, ["hour"]), 6, "synthetic_bid", "synthetic_ask"), 4, "edge")


def price_panel(t):
    from quotemill.operators.joins import aligned_panel

    return aligned_panel(t.orders.groupBy(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("asset")).agg(F.avg("o_totalprice").alias("level")), ASSETS, "level")


_PAIRS = [(ASSETS[i], ASSETS[j], i, j) for i in range(5) for j in range(i + 1, 5)]
LEVEL_PANEL = RETURNS + ", lw AS (SELECT ts, " + ", ".join(f"max(level) FILTER (asset = '{a}') AS a{k}" for k, a in enumerate(ASSETS)) + " FROM panel GROUP BY ts HAVING count(*) = 5), rw AS (SELECT * FROM lw ORDER BY ts DESC LIMIT 500), pr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, ts, a{i} AS x, a{j} AS y FROM rw" for a, b, i, j in _PAIRS) + """),
hr AS (SELECT a, b, regr_slope(x, y) AS h, corr(x, y) AS corr FROM pr GROUP BY 1, 2),
sp AS (SELECT a, b, ts, x - h * y AS s, h, corr FROM pr JOIN hr USING (a, b)),
zs AS (SELECT a, b, any_value(h) AS h, any_value(corr) AS corr, arg_max(s, ts) AS spread, avg(s) AS m, stddev_pop(s) AS sd FROM sp GROUP BY 1, 2)"""


@query("hedge_ratios", f"WITH {LEVEL_PANEL} SELECT a, b, {R('h')} AS hedge_ratio, {R('corr')} AS corr, {R('spread', 2)} AS spread, {R('m', 2)} AS spread_mean, {R('sd', 2)} AS spread_std FROM zs")
def _hedge(t):
    c = P.cointegration(price_panel(t), "ts", ASSETS, 500)
    out = c.select("a", "b", "hedge_ratio", "corr", "spread", "spread_mean", "spread_std")
    return rounded(rounded(out, 6, "hedge_ratio", "corr"), 2, "spread", "spread_mean", "spread_std")


def _polynomial(coef, x: str) -> str:
    return " + ".join(f"({v!r}) * pow({x}, {k})" for k, v in enumerate(coef))


_SURFACE = UNIT_ROOT[2]
_SCORE = f"CASE WHEN t <= {_SURFACE['star']} THEN {_polynomial(_SURFACE['small'], 't')} ELSE {_polynomial(_SURFACE['large'], 't')} END"
_LEVELS = ", ".join(f"t < {_polynomial(coef, '(1 / n)')} AS cointegrated_{round(level * 100)}pct" for level, coef in COINTEGRATION_CRITICAL.items())


@query("cointegration", f"""WITH {LEVEL_PANEL},
u AS (SELECT a, b, lag(s) OVER w AS x, s - lag(s) OVER w AS y, lag(s) OVER w - lag(s, 2) OVER w AS z FROM sp WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
g AS (SELECT a, b, count(*)::DOUBLE AS n, var_pop(x) AS xx, var_pop(z) AS zz, var_pop(y) AS yy, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM u WHERE z IS NOT NULL GROUP BY 1, 2),
bt AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM g),
tt AS (SELECT a, b, n, bx / sqrt((yy - bx * xy - bz * zy) / (n - 3) * zz / det) AS t FROM bt),
v AS (SELECT *, {_SCORE} AS v FROM tt)
SELECT a, b, {R('t')} AS adf_t, {R(f"CASE WHEN t > {_SURFACE['high']} THEN 1.0 WHEN t < {_SURFACE['low']} THEN 0.0 WHEN v < 0 THEN {normal_tails('v')} / 2 ELSE 1 - {normal_tails('v')} / 2 END")} AS p_value, {_LEVELS} FROM v""")
def _coint(t):
    out = P.cointegration(price_panel(t), "ts", ASSETS, 500, top=10)
    return rounded(out.select("a", "b", "adf_t", "p_value", "cointegrated_1pct", "cointegrated_5pct", "cointegrated_10pct"), 6, "adf_t", "p_value")


@query("pair_signals", f"WITH {LEVEL_PANEL} SELECT a, b, {R('(spread - m) / sd')} AS z_score, CASE WHEN (spread - m) / sd < -1 THEN 1.0::DOUBLE WHEN (spread - m) / sd > 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM zs")
def _signals(t):
    s = P.pair_signals(P.cointegration(price_panel(t), "ts", ASSETS, 500), 1.0)
    return rounded(s.select("a", "b", "z_score", "position"), 6, "z_score")


@query("stat_arb_weights", f"""WITH {LEVEL_PANEL}, p AS (SELECT *, CASE WHEN (spread - m) / sd < -1 THEN 1 WHEN (spread - m) / sd > 1 THEN -1 ELSE 0 END AS pos FROM zs),
act AS (SELECT *, pos * 1.0 / count(*) OVER () AS w FROM p WHERE pos <> 0), l AS (SELECT a AS asset, w FROM act UNION ALL SELECT b, -w * h FROM act),
g AS (SELECT asset, sum(w) AS raw FROM l GROUP BY 1)
SELECT asset, {R('raw / sum(abs(raw)) OVER ()')} AS weight FROM g""")
def _arbw(t):
    return rounded(P.stat_arb_weights(P.pair_signals(P.cointegration(price_panel(t), "ts", ASSETS, 500), 1.0)))
