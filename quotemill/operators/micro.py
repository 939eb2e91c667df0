"""Order books and order flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import ieee_quotient, tick_align
from quotemill.operators.ordered import Panel, Series, cumulative, index_rows

c = F.col


def drop_stale(deltas: DataFrame, s: Series, sequence: str = "sequence") -> DataFrame:
    """Keep updates whose sequence exceeds every sequence that arrived before, per key."""
    idx = cumulative(index_rows(deltas, s), s, {"_top": ("max", sequence)}, indexed=True)
    p = Panel(idx, s, indexed=True)
    p.lag("_prev", "_top")
    return p.done().filter(c("_prev").isNull() | (c(sequence) > c("_prev"))).drop("_top", "_prev")


def book_state(deltas: DataFrame, tick: float, depth: int, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("sequence",)) -> DataFrame:
    """Resting levels after all deltas: last size per (side, aligned price), size 0 removes, best ``depth`` per side.

    Rank 1 is the best level.  Ranking works on the surviving levels only, not on the deltas.
    """
    keys = list(keys)
    levels = deltas.withColumn("price", tick_align("price", tick)).groupBy(*keys, "side", "price").agg(
        F.max_by("size", F.struct(*order)).alias("size"), F.count(F.lit(1)).alias("updates"))
    live = levels.filter("size > 0")
    best_first = F.when(c("side") == "bid", -c("price")).otherwise(c("price"))
    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best_first))
    return live.withColumn("level", rank).filter(c("level") <= depth)


def snapshots(levels: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Ranked levels to one row per key with sorted bid and ask arrays (bounded by the kept depth)."""
    def side(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(c("side") == name, F.struct("level", "price", "size"))))
        return F.transform(rows, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))

    return levels.groupBy(*keys).agg(side("bid").alias("bids"), side("ask").alias("asks"))


def sizes(levels: str, n: int | None = None) -> Column:
    xs = c(levels) if n is None else F.slice(levels, 1, n)
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["size"])


def mid_prices() -> dict[str, Column]:
    """mid, spread and size-weighted mid of the best levels; null when a side is empty."""
    b, a = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    bp, ap, bs, asz = b["price"], a["price"], b["size"], a["size"]
    mid = (bp + ap) / 2
    return {"mid": mid, "spread": ap - bp,
            "weighted_mid": F.when(bs + asz == 0, mid).otherwise(F.try_divide(bp * asz + ap * bs, bs + asz))}


def imbalance(b: Column, a: Column) -> Column:
    """(b - a) / (b + a), 0 without volume."""
    return F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))


def depth_imbalance(n: int = 5) -> Column:
    return imbalance(sizes("bids", n), sizes("asks", n))


def walk_cost(levels: str, target: Column, tick: float, buy: bool) -> Column:
    """Average price of taking ``target`` size from the book, as distance from the best price in ticks."""
    zero = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("value"))

    def take(acc: Column, x: Column) -> Column:
        got = F.least(acc["left"], x["size"])
        return F.struct((acc["left"] - got).alias("left"), (acc["value"] + got * x["price"]).alias("value"))

    start = zero.withField("left", target.cast("double"))
    end = F.aggregate(c(levels), start, take)
    filled = target - end["left"]
    best = F.get(levels, F.lit(0))["price"]
    vwap = F.try_divide(end["value"], filled)
    away = (vwap - best) if buy else (best - vwap)
    return F.when(target == 0, 0.0).otherwise(away / tick)


def slope(levels: str) -> Column:
    """Size-weighted distance of the levels from the best price, relative to it; 0 with fewer than two levels."""
    best = F.get(levels, F.lit(0))["price"]
    total = sizes(levels)
    moved = F.aggregate(c(levels), F.lit(0.0), lambda a, x: a + x["size"] * F.abs(x["price"] - best))
    return F.when(F.size(levels) < 2, 0.0).otherwise(F.try_divide(moved, total) / (best + 1e-10))


def book_features() -> dict[str, Column]:
    tb, ta = sizes("bids"), sizes("asks")
    m = mid_prices()
    return {"spread": m["spread"], "mid_price": m["mid"], "ob_imbalance": (tb - ta) / (tb + ta + 1e-10),
            "bid_slope": slope("bids"), "ask_slope": slope("asks"), "total_bid": tb, "total_ask": ta}


def snapshot_record(tick: float, size: float) -> dict[str, Column]:
    """Everything one book snapshot reports."""
    return {**mid_prices(), "imbalance": depth_imbalance(), "buy_impact": walk_cost("asks", F.lit(size), tick, True),
            "sell_impact": walk_cost("bids", F.lit(size), tick, False)}


def flow(p: Panel, n: int, size: str = "volume", is_buy: str = "is_buy") -> list[str]:
    """Signed order-flow imbalance and its absolute value (toxicity) over the last n trades."""
    buy = p.temp("_buy", F.when(c(is_buy), c(size)).otherwise(0.0))
    sell = p.temp("_sell", F.when(~c(is_buy), c(size)).otherwise(0.0))
    b, s = p.total(f"_buy_{n}", buy, n, min_periods=1), p.total(f"_sell_{n}", sell, n, min_periods=1)
    p.hide(b, s)
    ofi = p.add("order_flow_imbalance", imbalance(c(b), c(s)), [b, s])
    return [ofi, p.add("toxicity", F.abs(c(ofi)), [ofi])]


def rolling_book_imbalance(p: Panel, n: int, bid: str = "bid_volume", ask: str = "ask_volume") -> str:
    b, a = p.total(f"_b_{n}", bid, n, min_periods=1), p.total(f"_a_{n}", ask, n, min_periods=1)
    p.hide(b, a)
    return p.add("book_imbalance", imbalance(c(b), c(a)), [b, a])


def triangular(tops: DataFrame, pairs: DataFrame, at: Sequence[str], edge: float = 0.001) -> DataFrame:
    """Synthetic bid and ask of (base, quote) pairs from the tops of both books at the same time.

    ``pairs`` is a short list (base, quote); tops are unique per (symbol, at).  Over an ask of 0 the edge is infinite.
    """
    at = list(at)
    base = tops.select(*at, c("symbol").alias("base"), c("bid").alias("_bb"), c("ask").alias("_ba"))
    quote = tops.select(*at, c("symbol").alias("quote"), c("bid").alias("_qb"), c("ask").alias("_qa"))
    out = base.join(F.broadcast(pairs), "base").join(quote, [*at, "quote"])
    out = out.withColumns({"synthetic_bid": c("_bb") * c("_qb"), "synthetic_ask": c("_ba") * c("_qa")})
    out = out.filter(c("synthetic_bid") > (1 + edge) * c("synthetic_ask"))
    return out.withColumn("edge", ieee_quotient(c("synthetic_bid"), c("synthetic_ask")) - 1).drop("_bb", "_ba", "_qb", "_qa")
