"""Aggregations and time-aware joins."""

from pyspark.sql import functions as F

from quotemill.functions import scalars as S
from quotemill.operators import joins as J
from quotemill.operators import stats as A
from quotemill.plans.market import QUOTES, RETURNS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rnd, rounded

ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_returns(t):
    return J.aligned_panel(t.daily_returns, ASSETS, "ret")


WIDE = RETURNS + ", wide AS (SELECT ts, " + ", ".join(
    f"max(ret) FILTER (asset = '{a}') AS a{k}" for k, a in enumerate(ASSETS)) + " FROM daily GROUP BY ts HAVING count(*) = 5)"


@query("keyed_folds", f"""SELECT event_type, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, {R('avg(value)')} AS m FROM events GROUP BY 1""".replace("sum(value) AS s", f"{R('sum(value)', 3)} AS s"))
def _folds(t):
    f = A.fold_state(t.events, ["event_type"], {"s": ("sum", "value"), "n": ("count", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "m": ("mean", "value")})
    return rounded(rounded(f, 3, "s"), 6, "m")


@query("running_keyed_state", f"""WITH {TICKS} SELECT tie, symbol, count(*) OVER w AS n, {R('sum(price) OVER w', 3)} AS total, max(price) OVER w AS top
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, tie)""")
def _running(t):
    from quotemill.operators.ordered import cumulative

    d = t.ticks.withColumn("one", F.lit(1))
    out = cumulative(d, TICK_SERIES, {"n": ("sum", "one"), "total": ("sum", "price"), "top": ("max", "price")})
    return rounded(out.select("tie", "symbol", "n", "total", "top"), 3, "total")


@query("column_statistics", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", {R(f'avg({x})')} AS mean, {R(f'stddev_pop({x})')} AS std, min({x}) AS min, max({x}) AS max FROM lineitem" for x in NUMS))
def _colstats(t):
    return rounded(A.column_profile(t.lineitem, NUMS, ddof=0).select("column", "mean", "std", "min", "max"))


@query("reference_profile", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count({x}) AS n, {R(f'avg({x})', 5)} AS mean, {R(f'stddev_samp({x})', 5)} AS std, {R(f'skewness({x})', 5)} AS skew, {R(f'kurtosis({x})', 5)} AS kurtosis FROM lineitem" for x in NUMS))
def _profile(t):
    return rounded(A.column_profile(t.lineitem, NUMS).select("column", "n", "mean", "std", "skew", "kurtosis"), 5)


@query("percentile_profile", " UNION ALL ".join(
    "SELECT '%s' AS \"column\", %s FROM lineitem" % (x, ", ".join(f"{R(f'quantile_cont({x}, {p})')} AS p{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))) for x in NUMS))
def _percentiles(t):
    return rounded(A.percentile_profile(t.lineitem, NUMS, (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))


CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("category_profile", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS categories, (SELECT CAST({x} AS VARCHAR) FROM lineitem GROUP BY {x} ORDER BY count(*) DESC, CAST({x} AS VARCHAR) DESC LIMIT 1) AS mode, "
    f"{R(f'(SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY {x})) * 1.0 / count(*)')} AS mode_share, CAST(count(*) - count({x}) AS BIGINT) AS nulls FROM lineitem" for x in CATS))
def _categories(t):
    return rounded(A.category_profile(t.lineitem, CATS))


@query("category_distribution", f"SELECT o_orderpriority AS category, count(*) AS n, {R('count(*) * 1.0 / (SELECT count(*) FROM orders)')} AS share FROM orders GROUP BY 1")
def _dist(t):
    return rounded(A.distribution(t.orders, "o_orderpriority"))


@query("category_entropy", f"WITH p AS (SELECT count(*) * 1.0 / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type) SELECT {R('-sum(p * ln(p))', 9)} AS entropy FROM p")
def _entropy(t):
    return rounded(A.entropy(t.events, "event_type"), 9)


BIN = "CAST(coalesce(least(floor((ret - lo) / nullif(hi - lo, 0) * {n}), {m}), 0) AS INT)"


@query("return_entropy", f"""WITH {RETURNS}, l AS (SELECT asset, min(ret) AS lo, max(ret) AS hi, count(*) AS n FROM daily GROUP BY 1),
h AS (SELECT asset, {BIN.format(n=20, m=19)} AS b, count(*) / (any_value(n) * (any_value(hi) - any_value(lo)) / 20) AS d FROM daily JOIN l USING (asset) GROUP BY 1, 2)
SELECT asset, {R('-sum(d * ln(d))')} AS entropy FROM h GROUP BY 1""")
def _hentropy(t):
    return rounded(A.histogram_entropy(t.daily_returns, "ret", 20, ["asset"]))


@query("return_histogram", f"""WITH {RETURNS}, l AS (SELECT asset, min(ret) AS lo, max(ret) AS hi, count(*) AS n FROM daily GROUP BY 1),
h AS (SELECT asset, {BIN.format(n=30, m=29)} AS bin, count(*) AS c FROM daily JOIN l USING (asset) GROUP BY 1, 2),
g AS (SELECT asset, lo, hi, n, CAST(unnest(range(30)) AS INT) AS bin FROM l)
SELECT asset, bin, {R('lo + bin * (hi - lo) / 30')} AS left_edge, coalesce(c, 0) AS count, {R('coalesce(c, 0) / (n * (hi - lo) / 30)')} AS density FROM g LEFT JOIN h USING (asset, bin)""")
def _hist(t):
    return rounded(A.histogram(t.daily_returns, "ret", 30, ["asset"]))


@query("metric_summary", f"""WITH {TICKS} SELECT symbol, exchange, count(*) AS count, {R('sum(price)', 3)} AS sum, {R('avg(price)')} AS avg, min(price) AS min, max(price) AS max, {R('stddev_samp(price)')} AS std,
  {R('quantile_cont(price, 0.5)')} AS p50, {R('quantile_cont(price, 0.95)')} AS p95, {R('quantile_cont(price, 0.99)')} AS p99
FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def _metric(t):
    m = A.metric_summary(t.ticks, ["symbol", "exchange"], "price", "ts", "2024-01-10")
    return rounded(rounded(m, 3, "sum"), 6, "avg", "std", "p50", "p95", "p99")


@query("correlation_and_covariance", f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT '{ASSETS[i]}' AS a, '{ASSETS[j]}' AS b, {R(f'corr(a{i}, a{j})')} AS corr, {R(f'covar_samp(a{i}, a{j}) * 252', 4)} AS annual_cov FROM wide"
    for i in range(5) for j in range(i + 1, 5)))
def _corr(t):
    return rounded(rounded(A.pair_correlations(wide_returns(t), ASSETS), 6, "corr"), 4, "annual_cov")


@query("correlation_matrix_ml", f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, {R(f'corr(a{i}, a{j})')} AS corr FROM wide" if i != j else f"SELECT {i} AS i, {i} AS j, 1.0::DOUBLE AS corr" for i in range(5) for j in range(5)))
def _corr_ml(t):
    """The whole matrix from one Gramian; for panels of many assets."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    wide = wide_returns(t)
    vec = VectorAssembler(inputCols=ASSETS, outputCol="v").transform(wide).select("v")
    m = Correlation.corr(vec, "v").first()[0].toArray()
    rows = [(i, j, float(m[i, j])) for i in range(5) for j in range(5)]
    return rounded(t.spark.createDataFrame(rows, "i int, j int, corr double"))


@query("strong_correlations", f"WITH {WIDE}, p AS (" + " UNION ALL ".join(
    f"SELECT '{ASSETS[i]}' AS a, '{ASSETS[j]}' AS b, corr(a{i}, a{j}) AS c FROM wide" for i in range(5) for j in range(i + 1, 5))
    + f") SELECT a, b, {R('c')} AS corr FROM p WHERE abs(c) >= 0.02")
def _strong(t):
    return rounded(A.pair_correlations(wide_returns(t), ASSETS, 0.02).select("a", "b", "corr"))


@query("volume_profile", f"WITH {TICKS} SELECT symbol, round(price, 1) AS price_level, sum(volume) AS volume FROM ticks GROUP BY 1, 2")
def _vp(t):
    return A.volume_profile(t.ticks, 1)


@query("shared_bin_histogram", f"""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
h AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) FILTER (o_orderdate < DATE '1996-01-01') AS n_ref, count(*) FILTER (o_orderdate >= DATE '1996-01-01') AS n_cur FROM orders, b GROUP BY 1)
SELECT 'o_totalprice' AS feature, bin, CAST(coalesce(n_ref, 0) AS BIGINT) AS n_ref, CAST(coalesce(n_cur, 0) AS BIGINT) AS n_cur FROM (SELECT CAST(unnest(range(10)) AS INT) AS bin) LEFT JOIN h USING (bin)""")
def _shared(t):
    from quotemill.operators.drift import shared_histogram

    o = t.orders
    return shared_histogram(o.filter("o_orderdate < DATE'1996-01-01'"), o.filter("o_orderdate >= DATE'1996-01-01'"), ["o_totalprice"], 10)


@query("completeness_counts", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count(*) AS rows, count(*) - count({x}) AS nulls, count(DISTINCT {x}) AS \"distinct\", {R(f'(count(*) - count({x})) * 1.0 / count(*)')} AS null_ratio, {R(f'count(DISTINCT {x}) * 1.0 / count(*)')} AS distinct_ratio FROM orders" for x in ("o_orderkey", "o_custkey", "o_orderstatus")))
def _complete(t):
    return rounded(A.completeness_counts(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"]))


@query("duplicate_counts", f"WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows, {R('sum(n - 1) * 1.0 / sum(n)')} AS duplicate_ratio FROM g")
def _dups(t):
    return rounded(A.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"]))


POSITIONS = """pos AS (SELECT o_custkey % 50 AS portfolio, o_orderpriority AS symbol, sum(o_totalprice) / 1000 AS quantity, avg(o_totalprice) / 1000 AS entry_price FROM orders GROUP BY 1, 2),
px AS (SELECT o_orderpriority AS symbol, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 1000 AS last_price FROM orders GROUP BY 1)"""


def positions_view(t):
    o = t.orders
    pos = o.groupBy((F.col("o_custkey") % 50).alias("portfolio"), F.col("o_orderpriority").alias("symbol")).agg(
        (F.sum("o_totalprice") / 1000).alias("quantity"), (F.avg("o_totalprice") / 1000).alias("entry_price"))
    px = o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(
        (F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")) / 1000).alias("last_price"))
    return pos, px


@query("concentration_hhi", f"WITH {POSITIONS}, w AS (SELECT portfolio, quantity / sum(quantity) OVER (PARTITION BY portfolio) AS weight FROM pos) SELECT portfolio, {R('sum(weight * weight)')} AS hhi FROM w GROUP BY 1")
def _hhi(t):
    pos, _ = positions_view(t)
    total = pos.groupBy("portfolio").agg(F.sum("quantity").alias("total"))
    w = pos.join(total, "portfolio").withColumn("weight", F.col("quantity") / F.col("total"))
    return rounded(A.concentration(w, "weight", ["portfolio"]))


@query("win_rate", f"SELECT l_returnflag, {R('avg(CASE WHEN l_extendedprice * (1 - l_discount) > 40000 THEN 1.0 ELSE 0 END) * 100')} AS win_rate, count(*) AS trades FROM lineitem GROUP BY 1")
def _win(t):
    d = t.lineitem.withColumn("pnl", F.col("l_extendedprice") * (1 - F.col("l_discount")) - 40000)
    return rounded(A.win_rate(d, "pnl", ["l_returnflag"]))


@query("portfolio_summary", f"""WITH {POSITIONS} SELECT portfolio, {R('10000 + sum(quantity * last_price)', 2)} AS equity, {R('((10000 + sum(quantity * last_price)) / 1000000 - 1) * 100', 4)} AS return_pct,
  count(*) AS positions, {R('avg(CASE WHEN last_price > entry_price THEN 1.0 ELSE 0 END) * 100')} AS win_rate FROM pos JOIN px USING (symbol) GROUP BY 1""")
def _psummary(t):
    pos, px = positions_view(t)
    out = A.portfolio_summary(pos, px, F.lit(10000.0), F.lit(1000000.0))
    return rounded(rounded(rounded(out, 2, "equity"), 4, "return_pct"), 6, "win_rate")


@query("signal_vote", """SELECT user_id, CAST(sum(CASE WHEN value > 70 THEN 1 WHEN value < 30 THEN -1 ELSE 0 END) AS BIGINT) AS total,
  CASE WHEN sum(CASE WHEN value > 70 THEN 1 WHEN value < 30 THEN -1 ELSE 0 END) > 0.5 THEN 1 WHEN sum(CASE WHEN value > 70 THEN 1 WHEN value < 30 THEN -1 ELSE 0 END) < -0.5 THEN -1 ELSE 0 END AS vote FROM events GROUP BY 1""")
def _vote(t):
    s = t.events.withColumn("signal", F.when(F.col("value") > 70, 1).when(F.col("value") < 30, -1).otherwise(0))
    return A.signal_vote(s, "signal", ["user_id"])


@query("compound_return", f"WITH {RETURNS} SELECT asset, {R('sum(ln(1 + ret))', 8)} AS log_total FROM daily GROUP BY 1")
def _compound(t):
    return t.daily_returns.groupBy("asset").agg(rnd(F.log1p(A.compound("ret")), 8).alias("log_total"))


# -- joins -----------------------------------------------------------------------------------------------


@query("asof_lookup", f"""WITH {TICKS}, l AS (SELECT symbol, ts, tie FROM ticks WHERE volume > 50), r AS (SELECT symbol, ts, price FROM ticks WHERE volume <= 50)
SELECT l.symbol, l.tie, r.price, r.ts AS matched_ts FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts""")
def _asof(t):
    left = t.ticks.filter("volume > 50").select("symbol", "ts", "tie")
    right = t.ticks.filter("volume <= 50").select("symbol", "ts", "tie", "price")
    return J.asof_join(left, right, TICK_SERIES, ["price"]).select("symbol", "tie", "price", "matched_ts")


@query("asof_lookup_with_tolerance", f"""WITH {TICKS}, l AS (SELECT symbol, ts, tie FROM ticks WHERE volume > 50), r AS (SELECT symbol, ts, price FROM ticks WHERE volume <= 50)
SELECT l.symbol, l.tie, CASE WHEN r.ts >= l.ts - INTERVAL 10 MINUTE THEN r.price END AS price FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts >= r.ts""")
def _asof_tol(t):
    left = t.ticks.filter("volume > 50").select("symbol", "ts", "tie")
    right = t.ticks.filter("volume <= 50").select("symbol", "ts", "tie", "price")
    return J.asof_join(left, right, TICK_SERIES, ["price"], tolerance="10 minutes").select("symbol", "tie", "price")


@query("feature_set_assembly", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, " + ", ".join(
    f"max(value) FILTER (event_type = '{e}') AS \"{e}\"" for e in ("click", "error", "view")) + " FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1, 2")
def _assembly(t):
    from quotemill.operators.bars import bucket

    v = t.events.filter(F.col("event_type").isin("click", "error", "view")).withColumn("day", bucket("ts", "1d"))
    return J.assemble_features(v, ["click", "error", "view"], "user_id", "day", "event_type", "value")


@query("aligned_returns", f"WITH {WIDE} SELECT ts, " + ", ".join(f"{R(f'a{k}')} AS a{k}" for k in range(5)) + " FROM wide")
def _aligned(t):
    return rounded(wide_returns(t).toDF("ts", "a0", "a1", "a2", "a3", "a4"))


VENUES = ("v0", "v1", "v2", "v3")


def _standing(v: str, column: str) -> str:
    return f"last_value(CASE WHEN exchange = '{v}' THEN {column} END IGNORE NULLS) OVER w"


@query("venue_arbitrage", f"""WITH {QUOTES}, s AS (SELECT tie, ts, symbol, """ + ", ".join(
    f"{_standing(v, c)} AS {c}_{k}" for k, v in enumerate(VENUES) for c in ("bid", "bid_size", "ask", "ask_size", "ts"))
    + """ FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (""" + " UNION ALL ".join(
        f"SELECT tie, ts, symbol, {k} AS k, '{v}' AS venue, bid_{k} AS bid, bid_size_{k} AS bid_size, ask_{k} AS ask, ask_size_{k} AS ask_size, epoch_us(ts - ts_{k}) / 1000.0 AS age FROM s"
        for k, v in enumerate(VENUES)) + f"""),
f AS (SELECT *, row_number() OVER (PARTITION BY tie ORDER BY bid DESC, k) AS rb, row_number() OVER (PARTITION BY tie ORDER BY ask, k) AS ra FROM l WHERE age <= 1800000),
m AS (SELECT a.symbol, a.tie, a.ts, a.venue AS buy_exchange, b.venue AS sell_exchange, a.ask AS buy_price, b.bid AS sell_price, least(a.ask_size, b.bid_size) AS quantity, abs(a.age - b.age) AS gap_ms
  FROM f a JOIN f b ON a.tie = b.tie AND a.ra = 1 AND b.rb = 1)
SELECT symbol, tie, ts, buy_exchange, sell_exchange, {R('buy_price')} AS buy_price, {R('sell_price')} AS sell_price, quantity, gap_ms,
  {R('(sell_price - buy_price) / buy_price * 10000', 4)} AS spread_bps, {R('(sell_price - buy_price) * quantity', 4)} AS pnl,
  (sell_price - buy_price) / buy_price - 0.0005 > 0 AND (sell_price - buy_price) * quantity * (1 - 0.0005) > 1e-4 AND quantity * buy_price > 1000 AS viable
FROM m WHERE buy_exchange <> sell_exchange AND sell_price > buy_price""")
def _venues(t):
    out = J.arbitrage(J.venue_match(t.quotes, TICK_SERIES, VENUES, 1_800_000.0))
    return rounded(rounded(out, 6, "buy_price", "sell_price"), 4, "spread_bps", "pnl")


ORDERS_SQL = QUOTES + """, o AS (SELECT tie AS order_id, symbol, ts, price, volume,
  CASE WHEN volume >= 90 THEN 'limit' WHEN volume >= 80 THEN 'stop' ELSE 'stop_limit' END AS type, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
  FROM ticks WHERE volume >= 70),
o2 AS (SELECT *, CASE WHEN side = 'buy' THEN price * 0.8 ELSE price * 1.2 END AS limit_price, CASE WHEN side = 'buy' THEN price * 1.1 ELSE price * 0.9 END AS stop_price FROM o)"""


def trigger_orders(t):
    ticks = t.ticks.filter("volume >= 70")
    buy = F.col("user_id") % 2 == 0
    p = F.col("price")
    return ticks.select(
        F.col("tie").alias("order_id"), "symbol", "ts",
        F.when(F.col("volume") >= 90, "limit").when(F.col("volume") >= 80, "stop").otherwise("stop_limit").alias("type"),
        F.when(buy, "buy").otherwise("sell").alias("side"),
        F.when(buy, p * 0.8).otherwise(p * 1.2).alias("price"), F.when(buy, p * 1.1).otherwise(p * 0.9).alias("stop_price"))


_FIRST = """SELECT o.symbol, o.order_id, min(q.ts) AS trigger_ts FROM {src} o JOIN quotes q ON q.symbol = o.symbol AND q.ts >= o.{at}
  AND CASE WHEN o.side = 'buy' THEN {buy} ELSE {sell} END WHERE {cond} GROUP BY 1, 2"""


@query("order_triggers", f"""WITH {ORDERS_SQL}, lim AS ({_FIRST.format(src='o2', at='ts', buy='q.ask <= o.limit_price', sell='q.bid >= o.limit_price', cond="o.type = 'limit'")}),
stp AS ({_FIRST.format(src='o2', at='ts', buy='q.ask >= o.stop_price', sell='q.bid <= o.stop_price', cond="o.type <> 'limit'")}),
armed AS (SELECT o2.*, stp.trigger_ts AS at FROM stp JOIN o2 USING (order_id) WHERE type = 'stop_limit'),
sl AS ({_FIRST.format(src='armed', at='at', buy='q.ask <= o.limit_price', sell='q.bid >= o.limit_price', cond='true')})
SELECT order_id, symbol, trigger_ts FROM lim UNION ALL SELECT order_id, stp.symbol, trigger_ts FROM stp JOIN o2 USING (order_id) WHERE type = 'stop'
UNION ALL SELECT order_id, symbol, trigger_ts FROM sl""")
def _triggers(t):
    return J.order_triggers(trigger_orders(t), t.quotes, TICK_SERIES).select("order_id", "symbol", "trigger_ts")


@query("portfolio_trades_lookup", "SELECT c.c_mktsegment AS portfolio, n.n_name AS owner, count(*) AS trades, " + R("sum(o.o_totalprice)", 2) + " AS notional FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= DATE '1996-01-01' GROUP BY 1, 2")
def _lookup(t):
    c, n = t.customer, t.nation
    d = t.orders.filter("o_orderdate >= DATE'1996-01-01'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy(F.col("c_mktsegment").alias("portfolio"), F.col("n_name").alias("owner")).agg(
        F.count(F.lit(1)).alias("trades"), rnd(F.sum("o_totalprice"), 2).alias("notional"))


@query("category_alignment", "SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_cur FROM (SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'AUTOMOBILE' GROUP BY 1) b ON a.category = b.category")
def _align(t):
    c = t.customer
    return J.category_counts(c.filter("c_acctbal < 0"), c.filter("c_acctbal >= 0 AND c_mktsegment <> 'AUTOMOBILE'"), "c_mktsegment")


@query("tag_filters", "SELECT p_partkey, contains(p_name, 'red') OR contains(p_name, 'blue') AS any_tag, contains(p_name, 'red') AND contains(p_name, 'widget') AS all_tags FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'blue')")
def _tagfilter(t):
    d = t.part.withColumn("tags", F.split("p_name", " "))
    return d.filter(S.has_any("tags", ["red", "blue"])).select("p_partkey", S.has_any("tags", ["red", "blue"]).alias("any_tag"), S.has_all("tags", ["red", "widget"]).alias("all_tags"))
