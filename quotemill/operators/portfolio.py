"""Positions, limits, weights, rebalancing, and the returns of signals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.scalars import uniform_draw
from quotemill.operators import gram
from quotemill.operators.ordered import Panel, Series, attach, cumulative, index_rows
from quotemill.operators.scans import affine_scan
from quotemill.session import materialize

c = F.col


def positions(trades: DataFrame, s: Series, qty: str = "quantity", price: str = "price", side: str = "side") -> DataFrame:
    """Long-only average-cost book after each trade: quantity, entry price, realised and unrealised P&L.

    A sell takes at most what is held; ``oversold`` marks the trades that asked for more.  The quantity is the
    running sum lifted off its running minimum; the cost basis is a recurrence whose factor is the share kept.
    """
    signed = F.when(c(side) == "buy", c(qty)).otherwise(-c(qty))
    t = index_rows(trades.withColumn("_d", signed.cast("double")), s)
    t = materialize(cumulative(t, s, {"_sum": ("sum", "_d")}, indexed=True), "position-sum")
    t = cumulative(t, s, {"_min": ("min", "_sum")}, indexed=True)
    t = t.withColumn("held", c("_sum") - F.least(c("_min"), F.lit(0.0)))
    p = Panel(t, s, indexed=True)
    p.add("_before", F.coalesce(F.lag("held").over(p.w), F.lit(0.0)), back=1)
    t = p.done(keep_index=True).withColumns(
        {
            "_a": F.when(c("_d") >= 0, 1.0).otherwise(F.coalesce(F.try_divide(c("held"), c("_before")), F.lit(0.0))),
            "_u": F.when(c("_d") > 0, c("_d") * c(price)).otherwise(0.0),
            "oversold": c("_d") < -c("_before"),
        }
    )
    t = materialize(affine_scan(t, s, "_a", "_u", "cost_basis", indexed=True), "position-cost")
    q = Panel(t, s, indexed=True)
    q.add("_cost_before", F.coalesce(F.lag("cost_basis").over(q.w), F.lit(0.0)), back=1)
    t = q.done(keep_index=True)
    sold = F.when(c("_d") < 0, c("_before") - c("held")).otherwise(0.0)
    gain = F.when(sold > 0, sold * c(price) - sold * F.try_divide(c("_cost_before"), c("_before"))).otherwise(0.0)
    t = cumulative(t.withColumn("_gain", gain), s, {"realized_pnl": ("sum", "_gain")}, indexed=True)
    t = t.withColumns(
        {
            "entry_price": F.coalesce(F.try_divide(c("cost_basis"), c("held")), F.lit(0.0)),
            "unrealized_pnl": F.when(c("held") > 0, c("held") * c(price) - c("cost_basis")).otherwise(0.0),
        }
    )
    return t.drop("_d", "_sum", "_min", "_before", "_a", "_u", "_cost_before", "_gain", "_i")


def inverse_volatility(signals: DataFrame, signal: str = "signal", vol: str = "volatility") -> DataFrame:
    """Positive signals share the capital in inverse proportion to volatility, the rest get 0."""
    inv = F.when((c(signal) > 0) & (c(vol) > 0), 1 / c(vol)).otherwise(0.0)
    d = signals.withColumn("_inv", inv)
    total = d.agg(F.sum("_inv").alias("_total"))
    return attach(d, total).withColumn("weight", F.coalesce(F.try_divide(c("_inv"), c("_total")), F.lit(0.0))).drop("_inv", "_total")


def portfolio_correlations(book: DataFrame, cov: DataFrame) -> DataFrame:
    """Correlation of every position's returns with those of its portfolio, from the long covariance (a, b, cov).

    ``book`` has portfolio, symbol, weight.  Symbols without covariance add nothing; without variance the answer is null.
    """
    held = book.groupBy("portfolio", "symbol").agg(F.sum("weight").alias("weight"))
    part = held.join(cov.withColumnsRenamed({"b": "symbol"}), "symbol").groupBy("portfolio", "a").agg(F.sum(c("weight") * c("cov")).alias("with_portfolio"))
    own = cov.filter("a = b").select("a", c("cov").alias("var"))
    rows = held.withColumnRenamed("symbol", "a").join(part, ["portfolio", "a"]).join(own, "a")
    total = rows.groupBy("portfolio").agg(F.sum(c("weight") * c("with_portfolio")).alias("portfolio_var"))
    corr = F.try_divide(c("with_portfolio"), F.sqrt(c("var") * c("portfolio_var")))
    return rows.join(total, "portfolio").select("portfolio", c("a").alias("symbol"), corr.alias("correlation"))


def limit_checks(book: DataFrame, max_weight: float = 0.2, max_leverage: float = 5.0, max_sector: float = 0.4,
                 correlations: DataFrame | None = None, max_correlation: float = 0.7) -> DataFrame:
    """Flags per position: weight within limits, sector within its share, gross leverage within its bound, and, given
    ``portfolio_correlations``, returns not too much like the portfolio's (unknown ones pass).

    ``book`` has portfolio, symbol, sector, weight; sums per portfolio and sector are partial aggregates.
    """
    gross = book.groupBy("portfolio").agg(F.sum(F.abs("weight")).alias("leverage"))
    sector = book.groupBy("portfolio", "sector").agg(F.sum(F.abs("weight")).alias("sector_weight"))
    out = book.join(gross, "portfolio").join(sector, ["portfolio", "sector"])
    check = F.when(c("weight") > max_weight, "max_weight").when(c("weight") < -max_weight, "min_weight").otherwise("ok")
    out = out.withColumns({"weight_check": check, "leverage_ok": c("leverage") <= max_leverage, "sector_ok": c("sector_weight") <= max_sector})
    passed = (c("weight_check") == "ok") & c("leverage_ok") & c("sector_ok")
    if correlations is not None:
        out = out.join(correlations, ["portfolio", "symbol"], "left")
        out = out.withColumn("correlation_ok", F.coalesce(F.abs("correlation") <= max_correlation, F.lit(True)))
        passed = passed & c("correlation_ok")
    return out.withColumn("passed", passed)


def drawdown_ok(value: Column, peak: Column, limit: float = 0.2) -> Column:
    return F.when(peak == 0, True).otherwise((peak - value) / peak <= limit)


def exit_levels(side: str = "side", entry: str = "entry_price", stop: float = 0.05, take: float = 0.10) -> dict[str, Column]:
    long = F.lower(c(side)) == "buy"
    return {"stop_loss": c(entry) * F.when(long, 1 - stop).otherwise(1 + stop),
            "take_profit": c(entry) * F.when(long, 1 + take).otherwise(1 - take)}


def exit_status(price: Column, entry: Column, stop: float = 0.05, take: float = 0.10) -> Column:
    change = F.try_divide(price - entry, entry)
    return F.when(change <= -stop, "STOP_LOSS").when(change >= take, "TAKE_PROFIT").otherwise("OK")


def rebalance(held: DataFrame, targets: DataFrame, prices: DataFrame, keys: Sequence[str] = ("portfolio",), min_trade: float = 1e-6) -> DataFrame:
    """Orders that bring holdings to target weights; no order below ``min_trade`` in value or without a price."""
    keys = list(keys)
    valued = held.join(prices, "symbol").withColumn("_value", c("quantity") * c("last_price"))
    total = valued.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    wanted = targets.join(total, keys).join(valued.select(*keys, "symbol", "_value"), [*keys, "symbol"], "left").join(prices, "symbol")
    diff = c("target_weight") * c("_total") - F.coalesce("_value", F.lit(0.0))
    out = wanted.withColumn("_diff", diff).filter((F.abs("_diff") >= min_trade) & (c("last_price") > 0))
    return out.select(*keys, "symbol", F.when(c("_diff") > 0, "buy").otherwise("sell").alias("side"),
                      (F.abs("_diff") / c("last_price")).alias("quantity"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """w (S w) / (w' S w) per asset from the long covariance (a, b, cov)."""
    wb = weights.select(c("asset").alias("b"), c("weight").alias("_wb"))
    sw = cov.join(wb, "b").groupBy("a").agg(F.sum(c("cov") * c("_wb")).alias("_sw"))
    per = sw.join(weights.select(c("asset").alias("a"), "weight"), "a").withColumn("_part", c("weight") * c("_sw"))
    total = per.agg(F.sum("_part").alias("_var"))
    return attach(per, total).select(c("a").alias("asset"), F.try_divide(c("_part"), c("_var")).alias("contribution"))


def _moments(wide: DataFrame, assets: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Annual mean vector and covariance matrix of the panel's columns, k + k * k numbers."""
    k = len(assets)
    pairs = gram.co_moments(wide, gram.vector(assets), k).persist()
    try:
        mean = np.diag(gram.as_matrix(pairs.filter("i = j"), k, c("mean_i")))
        return mean * 252, gram.as_matrix(pairs, k, gram.covariance()) * 252
    finally:
        pairs.unpersist()


def random_portfolios(spark: SparkSession, wide: DataFrame, assets: Sequence[str], draws: int = 1000, seed: int = 11, rf: float = 0.02) -> DataFrame:
    """Dirichlet(1) weights (normalised exponentials) with return, volatility and Sharpe ratio; seed and number decide a draw."""
    mu, cov = _moments(wide, assets)
    k = len(assets)
    d = spark.range(draws).select(c("id").alias("draw"), *[(-F.log(uniform_draw(seed, "id", F.lit(i)))).alias(f"_e{i}") for i in range(k)])
    total = sum((c(f"_e{i}") for i in range(k)), F.lit(0.0))
    d = d.withColumns({f"w{i}": c(f"_e{i}") / total for i in range(k)})
    ret = sum((c(f"w{i}") * float(mu[i]) for i in range(k)), F.lit(0.0))
    var = sum((c(f"w{i}") * c(f"w{j}") * float(cov[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    d = d.withColumns({"ret": ret, "vol": F.sqrt(var)}).withColumn("sharpe", (c("ret") - rf) / (c("vol") + 1e-9))
    return d.select("draw", *[c(f"w{i}").alias(a) for i, a in enumerate(assets)], "ret", "vol", "sharpe")


def _cluster_order(dist: np.ndarray) -> list[int]:
    """Leaf order of single-linkage clustering."""
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        _, x, y = min((dist[np.ix_(g, h)].min(), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y)
        merged = groups[x] + groups[y]
        groups = [g for k, g in enumerate(groups) if k not in (x, y)] + [merged]
    return groups[0]


def _parity(cov: np.ndarray, items: list[int], weight: float, out: np.ndarray) -> None:
    """Split the weight between halves in inverse proportion to their inverse-variance portfolio's variance."""
    if len(items) == 1:
        out[items[0]] = weight
        return
    halves = items[: len(items) // 2], items[len(items) // 2:]
    var = []
    for h in halves:
        sub = cov[np.ix_(h, h)]
        w = 1 / np.diag(sub)
        w /= w.sum()
        var.append(w @ sub @ w)
    share = 1 - var[0] / (var[0] + var[1])
    _parity(cov, halves[0], weight * share, out)
    _parity(cov, halves[1], weight * (1 - share), out)


TAIL_BINS, TAIL_ROWS, TAIL_VALUES, TAIL_PASSES = 256, 1024, 64, 40
_PARTIAL = "draw bigint, below bigint, total double, lowest double, highest double, bins array<bigint>"


def _tail_pass(names: list[str], weights: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Per draw over the rows of a task: how many returns lie below ``low``, their sum, and a histogram of those up to ``high``."""
    draws, width = len(weights), np.subtract(high, low, out=np.ones(len(weights)), where=(high > low) & np.isfinite(high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, total, bins = np.zeros(draws, np.int64), np.zeros(draws), np.zeros(draws * TAIL_BINS, np.int64)
        least, most = np.full(draws, np.inf), np.full(draws, -np.inf)
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            for at in range(0, len(x), TAIL_ROWS):
                r = x[at : at + TAIL_ROWS] @ weights.T
                under, inside = r < low, (r >= low) & (r <= high)
                below, total = below + under.sum(0), total + np.where(under, r, 0.0).sum(0)
                least, most = np.minimum(least, r.min(0)), np.maximum(most, r.max(0))
                with np.errstate(invalid="ignore"):
                    place = np.clip((r - low) / width * TAIL_BINS, 0, TAIL_BINS - 1)
                place = np.where(inside, place, 0).astype(np.int64) + np.arange(draws) * TAIL_BINS
                bins += np.bincount(place[inside], minlength=draws * TAIL_BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(draws)), pa.array(below), pa.array(total), pa.array(least), pa.array(most), pa.array(list(bins.reshape(draws, -1)), pa.list_(pa.int64()))],
            ["draw", "below", "total", "lowest", "highest", "bins"])

    return run


def _tail_values(names: list[str], weights: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Per draw the distinct returns from ``low`` to ``high`` and how often a task has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            for at in range(0, len(x), TAIL_ROWS):
                r = x[at : at + TAIL_ROWS] @ weights.T
                row, draw = np.nonzero((r >= low) & (r <= high))
                yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(r[row, draw])], ["draw", "ret"])

    return run


def tail_means(wide: DataFrame, assets: Sequence[str], draws: pd.DataFrame, share: float = 0.05) -> pd.DataFrame:
    """Mean of the worst ``share`` of each drawn portfolio's returns (``draw``, ``cvar_5``); ``draws`` has a row per draw.

    Each pass over the panel narrows, for every draw, the range that holds its quantile, by histograms summed over tasks;
    what reaches the driver is a histogram per draw.  The few returns left in the range give the exact quantile.
    """
    names, weights, k = list(assets), draws[list(assets)].to_numpy(float), len(draws)
    rows = wide.select(*[c(f"`{a}`").cast("double").alias(a) for a in names]).dropna()

    def look(low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
        parts = rows.mapInArrow(_tail_pass(names, weights, low, high), _PARTIAL)
        cells = parts.select("draw", "below", "total", "lowest", "highest", F.posexplode("bins").alias("bin", "n"))
        first = F.when(c("bin") == 0, c("below")).otherwise(0), F.when(c("bin") == 0, c("total")).otherwise(0.0)
        per = cells.groupBy("draw", "bin").agg(F.sum("n").alias("n"), F.sum(first[0]).alias("below"), F.sum(first[1]).alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
        return per.groupBy("draw").agg(F.sum("below").alias("below"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
                                       F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("bins")).orderBy("draw").toPandas()

    got = look(np.full(k, np.inf), np.full(k, np.inf))  # counts and extremes
    low, high, place = got["lowest"].to_numpy(float), got["highest"].to_numpy(float), share * (got["below"].to_numpy() - 1)
    if not np.isfinite(low).all():
        return pd.DataFrame({"draw": draws["draw"].to_numpy(), "cvar_5": np.nan})
    for _ in range(TAIL_PASSES):
        got = look(low, high)
        bins = np.array(got["bins"].tolist())
        if (bins.sum(1) <= TAIL_VALUES).all():
            break
        upto, edge = got["below"].to_numpy()[:, None] + np.cumsum(bins, 1), (high - low) / TAIL_BINS
        a, b = ((upto > whole(place)[:, None]).argmax(1) for whole in (np.floor, np.ceil))
        nearer = np.maximum(low, low + (a - 1) * edge), np.minimum(high, low + (b + 2) * edge)  # a bin more on either side, for rounding
        if (nearer[0] <= low).all() and (nearer[1] >= high).all():
            break  # as narrow as numbers are: few distinct returns
        low, high = nearer
    left = rows.mapInArrow(_tail_values(names, weights, low, high), "draw bigint, ret double").groupBy("draw", "ret").agg(F.count(F.lit(1)).alias("n")).orderBy("draw", "ret").toPandas()
    out = np.empty(k)
    for d, part in left.groupby("draw"):
        value, n = part["ret"].to_numpy(), part["n"].to_numpy()
        rank = np.cumsum(n) + got["below"][d]
        at = lambda p: value[(rank > p).argmax()]
        lo, hi = at(math.floor(place[d])), at(math.ceil(place[d]))
        q = lo + (hi - lo) * (place[d] - math.floor(place[d]))
        tail = value <= q
        out[d] = (got["total"][d] + (value * n)[tail].sum()) / (got["below"][d] + n[tail].sum())
    return pd.DataFrame({"draw": draws["draw"].to_numpy(), "cvar_5": out})


def optimal_weights(spark: SparkSession, wide: DataFrame, assets: Sequence[str], method: str = "min_variance") -> DataFrame:
    """Weights from moments computed by Spark; only the k x k algebra runs on the driver."""
    mu, cov = _moments(wide, assets)
    if method == "min_variance":
        w = np.linalg.solve(cov, np.ones(len(assets)))
        w = w / w.sum()
    elif method == "mean_variance":
        w = np.linalg.solve(cov, mu)
        w = w / np.abs(w).sum()
    elif method == "hierarchical":
        corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        w = np.zeros(len(assets))
        _parity(cov, _cluster_order(np.sqrt(np.clip(0.5 * (1 - corr), 0, None))), 1.0, w)
    elif method == "cvar":
        draws = random_portfolios(spark, wide, assets).select("draw", *assets).toPandas()
        best = tail_means(wide, assets, draws).sort_values(["cvar_5", "draw"], ascending=[False, True]).iloc[0]
        w = draws[draws["draw"] == best["draw"]][list(assets)].to_numpy()[0]
    else:
        raise ValueError(f"unknown method {method!r}")
    return spark.createDataFrame([(a, float(x)) for a, x in zip(assets, w)], "asset string, weight double")


def signal_returns(p: Panel, signal: str, price: str = "close", fee: float = 0.001, slippage: float = 0.0005, out: str = "strategy_ret") -> str:
    """Return of holding yesterday's signal, less costs on each change of position."""
    pos = p.temp(f"_pos_{out}", F.coalesce(F.lag(signal).over(p.w), F.lit(0)).cast("double"), [signal], back=1)
    prev = p.temp(f"_was_{out}", F.coalesce(F.lag(pos).over(p.w), F.lit(0.0)), [pos], back=1)
    past = p.temp(f"_px_{out}", F.lag(price).over(p.w), [price], back=1)
    gross = F.coalesce(F.try_divide(c(price), c(past)) - 1, F.lit(0.0)) * c(pos)
    return p.add(out, gross - F.abs(c(pos) - c(prev)) * (fee + slippage), [pos, prev, past, price])


def backtest_trades(df: DataFrame, s: Series, signal: str, price: str = "close", fee: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """One row per stretch of rows with one and the same signal other than 0: a trade.

    It is entered at the price of the stretch's first row and left at that of the first row after it, or still ``open`` at the
    last price.  Returns keys, ``trade`` (number within the key), side, times, prices, ``rows`` held, ``return_pct`` after costs on
    either side (on entry only while open) and ``status``.
    """
    keys = list(s.keys)
    d = df.withColumn("_sig", F.coalesce(F.signum(c(signal)), F.lit(0.0)))
    p = Panel(d, s)
    prev = p.temp("_was", F.lag("_sig").over(p.w), back=1)
    p.add("_begins", F.when(c(prev).isNull() | (c(prev) != c("_sig")), 1).otherwise(0), [prev])
    p.add("_after", F.lead(price).over(p.w), fwd=1)
    p.add("_after_ts", F.lead(s.ts).over(p.w), fwd=1)
    runs = cumulative(p.done(keep_index=True), s, {"_run": ("sum", "_begins")}, indexed=True).filter("_sig != 0")
    per = runs.groupBy(*keys, "_run").agg(
        F.max("_sig").alias("side"), F.min_by(s.ts, "_i").alias("entry_ts"), F.min_by(price, "_i").alias("entry_price"), F.count(F.lit(1)).alias("rows"),
        F.max_by(F.struct(c("_after_ts").alias("ts"), c("_after").alias("price"), c(s.ts).alias("own_ts"), c(price).alias("own_price")), "_i").alias("_end"))
    closed = c("_end.ts").isNotNull()
    exit_price = F.when(closed, c("_end.price")).otherwise(c("_end.own_price"))
    gain = F.try_divide(exit_price, c("entry_price")) - 1
    costs = F.when(closed, 2 * (fee + slippage)).otherwise(fee + slippage)
    return per.select(*keys, c("_run").cast("long").alias("trade"), c("side").cast("int").alias("side"), "entry_ts", F.when(closed, c("_end.ts")).otherwise(c("_end.own_ts")).alias("exit_ts"),
                      "entry_price", exit_price.alias("exit_price"), "rows", ((c("side") * gain - costs) * 100).alias("return_pct"),
                      F.when(closed, "closed").otherwise("open").alias("status"))


def crossover_search(df: DataFrame, s: Series, grid: Sequence[tuple[int, int]], folds: int = 4, price: str = "close") -> DataFrame:
    """Score moving-average crossovers on time-ordered folds; mean Sharpe ratio over keys and folds, best first.

    All parameter sets are columns of one panel, scored by one aggregate.
    """
    p = Panel(df, s)
    names = []
    for k, (fast, slow) in enumerate(grid):
        a, b = p.mean(f"_m{fast}", price, fast), p.mean(f"_m{slow}", price, slow)
        p.hide(a, b)
        sig = p.temp(f"_sig{k}", F.when(c(a) > c(b), 1).otherwise(0), [a, b])
        names.append(signal_returns(p, sig, price, out=f"_r{k}"))
    d = p.done(keep_index=True)
    size = d.groupBy(*s.keys).agg((F.max("_i") + 1).alias("_size"))
    d = d.join(size, list(s.keys)).withColumn("fold", F.floor(c("_i") * folds / c("_size")).cast("int"))
    sharpe = [F.struct(F.lit(f).alias("fast"), F.lit(sl).alias("slow"),
                       (F.try_divide(F.avg(n), F.stddev_samp(n)) * math.sqrt(252)).alias("sharpe"),
                       F.when(F.min(n) <= -1, F.lit(-1.0)).otherwise(F.expm1(F.sum(F.when(c(n) > -1, F.log1p(n))))).alias("total_return")).alias(f"_s{k}")
              for k, ((f, sl), n) in enumerate(zip(grid, names))]
    scored = d.groupBy(*s.keys, "fold").agg(*sharpe)
    long = scored.select(F.explode(F.array(*[f"_s{k}" for k in range(len(grid))])).alias("x")).select("x.*")
    return long.groupBy("fast", "slow").agg(F.avg("sharpe").alias("mean_sharpe"), F.avg("total_return").alias("mean_return")).orderBy(
        F.desc("mean_sharpe"), "fast", "slow")
