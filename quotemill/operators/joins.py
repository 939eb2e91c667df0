"""Time-aware joins: as-of, trigger matching, venue matching, alignment of return series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import ieee_quotient
from quotemill.operators.ordered import Series, cumulative, index_rows
from quotemill.session import materialize, scratch


def _both(left: DataFrame, right: DataFrame, s: Series, right_first: bool, payload: Column) -> DataFrame:
    """Union of two sides in one order; at equal times the side that must be seen comes first."""
    ids = [*s.keys, s.ts, *s.tie]
    a = left.select(*ids, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
                    F.lit(None).cast(payload_type(right, payload)).alias("_r"))
    b = right.select(*ids, F.lit(0 if right_first else 2).alias("_side"),
                     F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    return a.unionByName(b)


def payload_type(df: DataFrame, payload: Column):
    return df.select(payload.alias("x")).schema["x"].dataType


def asof_join(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], prefix: str = "",
              tolerance: str | None = None) -> DataFrame:
    """Newest right row at or before each left row's time, per key; no match leaves nulls.

    Both sides share the columns of ``s``.  One union, one ordered pass; a hot key is spread over blocks.
    """
    payload = F.struct(*[F.col(v) for v in values], F.col(s.ts).alias("_rts"))
    both = _both(left, right, s, True, payload)
    order = s.with_(tie=("_side", *s.tie))
    seen = cumulative(index_rows(both, order), order, {"_hit": ("last", "_r")}, indexed=True)
    out = seen.filter("_side = 1")
    hit = F.col("_hit")
    if tolerance:
        hit = F.when(F.col("_hit._rts") >= F.col(f"_l.{s.ts}") - F.expr(f"INTERVAL {tolerance}"), F.col("_hit"))
    out = out.withColumn("_hit", hit)
    return out.select("_l.*", *[F.col(f"_hit.{v}").alias(f"{prefix}{v}") for v in values],
                      F.col("_hit._rts").alias(f"{prefix}matched_{s.ts}"))


def _first_at_most(rows: DataFrame, probes: DataFrame, keys: list[str], block: int, lines: Sequence[str] = ("_v0",),
                   carry: Sequence[str] = ()) -> DataFrame:
    """For each probe (id, _line, _from, _limit): position ``_hit`` of the first row at or after ``_from`` whose value of the
    probe's line is <= limit, and what that row carries.

    Rows are (keys, _i, lines, carry).  A probe is tried in the block it starts in; the rest ask the same question of
    the block minima, which names the one later block that holds the answer.
    """
    rows = rows.withColumn("_block", F.floor(F.col("_i") / block))
    by = [*keys, "_block"]
    schema = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    carried = ["_hit", *carry]
    out_schema = ", ".join(f"`{k}` {schema[k]}" for k in by) + ", _id bigint, _line int, _limit double, _hit bigint" + "".join(f", `{k}` {schema[k]}" for k in carry)

    def climb(values: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """All probes of a line at once, over minima of stretches of 1, 2, 4, ... rows: a stretch without a hit is skipped."""
        low = [values]
        while len(low[-1]) > (step := 1 << (len(low) - 1)):
            low.append(np.minimum(low[-1][:-step], low[-1][step:]))
        for k in reversed(range(len(low))):
            inside = at < len(low[k])
            at = at + np.where(inside & (low[k][np.where(inside, at, 0)] > limit), 1 << k, 0)
        return at

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame()
        left = left.sort_values("_i", ignore_index=True)
        limit, line, at = right["_limit"].to_numpy(float), right["_line"].to_numpy(), np.searchsorted(left["_i"].to_numpy(), right["_from"].to_numpy())
        for k in np.unique(line) if len(left) else ():
            at[line == k] = climb(left[lines[k]].fillna(np.inf).to_numpy(float), at[line == k], limit[line == k])
        hits = left.assign(_hit=left["_i"])[carried].reindex(np.where(at < len(left), at, -1)).reset_index(drop=True)
        whole = {k: "Int64" for k in carried if schema.get(k, "bigint") == "bigint"}
        return pd.concat([right[[*by, "_id", "_line", "_limit"]].reset_index(drop=True), hits.astype(whole)], axis=1)

    def ask(p: DataFrame) -> DataFrame:
        """Probes of one block are dealt out in chunks of about a block; only blocks with probes are read."""
        chunks = p.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("_chunks"))
        dealt = p.join(chunks, by).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks"))).drop("_chunks")
        copies = rows.join(chunks, by).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))
        at = [*by, "_chunk"]
        return copies.drop("_chunks").groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(search, out_schema)

    first = materialize(ask(probes.withColumn("_block", F.floor(F.col("_from") / block))), "probe-first")
    found = first.filter("_hit IS NOT NULL").select(*keys, "_id", *carried)
    open_ = first.filter("_hit IS NULL")
    if open_.isEmpty():
        return found
    minima = materialize(rows.groupBy(*keys, F.col("_block").alias("_i")).agg(*[F.min(v).alias(v) for v in lines]), "probe-minima")
    if minima.agg(F.max("_i")).first()[0] in (None, 0):
        return found
    later = open_.select(*keys, "_id", "_line", "_limit", (F.col("_block") + 1).alias("_from"))
    where = _first_at_most(minima, later, keys, max(block, 4096), lines)
    again = later.join(where.withColumnRenamed("_hit", "_block"), [*keys, "_id"]).withColumn("_from", F.col("_block") * block)
    return found.unionByName(ask(again).filter("_hit IS NOT NULL").select(*keys, "_id", *carried))


def _in_one_order(orders: DataFrame, quotes: DataFrame, s: Series, values: dict[str, Column], order: Column) -> tuple[DataFrame, DataFrame]:
    """Orders and quotes of each key in one order, written once: position ``_i``, the first position of the same time ``_start``,
    the watched values (null for orders) and ``_order`` (null for quotes).

    An order comes before the quotes of its time, and is itself no quote that could trigger.  Returns all rows, and the orders
    among them as a second reading, so that the two may be joined.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    kind = payload_type(orders, order)
    q = quotes.select(*s.keys, s.ts, *s.tie, F.lit(1).alias("_side"), blank(kind).alias("_order"), *[v.cast("double").alias(n) for n, v in values.items()])
    o = orders.select(*s.keys, s.ts, *[blank(q.schema[x].dataType).alias(x) for x in s.tie], F.lit(0).alias("_side"), order.alias("_order"),
                      *[blank("double").alias(n) for n in values])
    both = materialize(o.unionByName(q), "trigger-both")  # read for the cuts, the sizes of slices and the order
    ordered = index_rows(both, s.with_(tie=("_side", *s.tie, "_order.id")), start="_start")
    spark, path = quotes.sparkSession, scratch(quotes.sparkSession, "trigger-rows")
    ordered.drop(*s.tie).write.parquet(path)
    return spark.read.parquet(path), spark.read.parquet(path).filter("_side = 0")


def first_trigger(orders: DataFrame, quotes: DataFrame, s: Series, order_id: str, level: str, value: Column,
                  below: bool = True) -> DataFrame:
    """First quote at or after each order whose ``value`` is <= the order's level (>= when not ``below``).

    Returns order id with the trigger's time and value; orders that never trigger are absent.
    """
    keys = list(s.keys)
    sign = 1.0 if below else -1.0
    order = F.struct(F.col(order_id).alias("id"), (F.col(level) * sign).cast("double").alias("limit"))
    rows, sent = _in_one_order(orders, quotes, s, {"_v0": value * sign}, order)
    probes = sent.filter("_order.limit IS NOT NULL").select(
        *keys, F.col("_order.id").alias("_id"), F.lit(0).alias("_line"), F.col("_i").alias("_from"), F.col("_order.limit").alias("_limit"))
    hits = _first_at_most(rows.select(*keys, "_i", "_v0", s.ts), probes, keys, s.block_rows, carry=(s.ts, "_v0"))
    return hits.select(*keys, F.col("_id").alias(order_id), F.col(s.ts).alias("trigger_ts"), (F.col("_v0") * sign).alias("trigger_value"))


# Which quote each order kind watches, and the sign that turns its test into "value <= level".
TRIGGER_LINES = {
    ("limit", "buy"): ("ask", 1.0),
    ("limit", "sell"): ("bid", -1.0),
    ("stop", "buy"): ("ask", -1.0),
    ("stop", "sell"): ("bid", 1.0),
}


def order_triggers(orders: DataFrame, quotes: DataFrame, s: Series) -> DataFrame:
    """Limit, stop and stop-limit orders against quotes (bid, ask): the first quote that executes each.

    Orders carry order_id, type, side, price and stop_price.  A buy executes on the ask, a sell on the bid; a
    stop-limit order becomes a limit order at the time its stop triggers.  Orders and quotes are put in one order once; a
    search looks at all lines (ask or bid, rising or falling) of a block together, so two searches over the same rows answer all.
    """
    keys, names = list(s.keys), list(TRIGGER_LINES)

    def probe(kind: str, level: str) -> Column:
        """The line an order of this kind watches and its level there."""
        buy = F.col("side") == "buy"
        sign = F.when(buy, TRIGGER_LINES[(kind, "buy")][1]).otherwise(TRIGGER_LINES[(kind, "sell")][1])
        return F.struct(F.when(buy, names.index((kind, "buy"))).otherwise(names.index((kind, "sell"))).alias("line"), (F.col(level) * sign).cast("double").alias("limit"))

    first = F.when(F.col("type") == "limit", probe("limit", "price")).otherwise(probe("stop", "stop_price"))
    order = F.struct(F.col("order_id").alias("id"), first.alias("first"), F.when(F.col("type") == "stop_limit", probe("limit", "price")).alias("then"))
    rows, sent = _in_one_order(orders.filter("type IS NOT NULL"), quotes, s, {"bid": F.col("bid"), "ask": F.col("ask")}, order)
    lines = [f"_v{k}" for k in range(len(names))]
    watched = rows.select(*keys, "_i", s.ts, "_start", *[(F.col(col) * sign).alias(v) for v, (col, sign) in zip(lines, TRIGGER_LINES.values())])

    def search(asked: DataFrame, at: str, start: str, carry: Sequence[str]) -> DataFrame:
        probes = asked.select(*keys, F.col("_order.id").alias("_id"), F.col(f"_order.{at}.line").alias("_line"), F.col(start).alias("_from"), F.col(f"_order.{at}.limit").alias("_limit"))
        return _first_at_most(watched.select(*keys, "_i", *lines, *carry), probes.filter("_limit IS NOT NULL"), keys, s.block_rows, lines, carry)

    hits = materialize(search(sent, "first", "_i", (s.ts, "_start")), "trigger-hits")
    held = sent.filter("_order.then IS NOT NULL").select(F.col("_order.id").alias("_id"), "_order")
    live = hits.join(held, "_id")  # from the first quote of the time at which the stop triggered
    armed = search(live, "then", "_start", (s.ts,))
    out = hits.join(held.select("_id"), "_id", "left_anti").select(*keys, "_id", s.ts).unionByName(armed.select(*keys, "_id", s.ts))
    return out.select(*keys, F.col("_id").alias("order_id"), F.col(s.ts).alias("trigger_ts"))


def venue_match(quotes: DataFrame, s: Series, venues: Sequence[str], max_gap_ms: float) -> DataFrame:
    """Crossings of standing quotes: at every update, the best bid and the best ask among the venues' latest quotes.

    A venue's quote stands until its next one; quotes further than ``max_gap_ms`` behind the update are stale, and
    bid and ask must sit on different venues with the bid above the ask.  Each venue is one running value of the
    series, so a busy symbol is scanned block by block.  Equal prices go to the venue named first.
    """
    sides = {f"_v{k}": F.when(F.col("exchange") == v, F.struct("bid", "bid_size", "ask", "ask_size", F.col(s.ts).alias("at"))) for k, v in enumerate(venues)}
    df = cumulative(quotes.withColumns(sides), s, {f"_s{k}": ("last", f"_v{k}") for k in range(len(venues))})

    def standing(k: int, *fields: Column) -> Column:
        q = F.col(f"_s{k}")
        age = F.timestamp_diff("MICROSECOND", q["at"], F.col(s.ts)) / F.lit(1000.0)
        return F.when(age <= max_gap_ms, F.struct(*fields, F.lit(k).alias("k"), age.alias("age")))

    bids = [standing(k, (-F.col(f"_s{k}")["bid"]).alias("price"), F.lit(k).alias("rank"), F.col(f"_s{k}")["bid_size"].alias("size")) for k in range(len(venues))]
    asks = [standing(k, F.col(f"_s{k}")["ask"].alias("price"), F.lit(k).alias("rank"), F.col(f"_s{k}")["ask_size"].alias("size")) for k in range(len(venues))]
    names = F.array(*[F.lit(v) for v in venues])
    out = df.withColumns({"_b": F.least(*bids), "_a": F.least(*asks)})
    out = out.select(
        *s.keys, s.ts, *s.tie,
        F.get(names, F.col("_a.k")).alias("buy_exchange"), F.get(names, F.col("_b.k")).alias("sell_exchange"),
        F.col("_a.price").alias("buy_price"), (-F.col("_b.price")).alias("sell_price"),
        F.least("_a.size", "_b.size").alias("quantity"), F.abs(F.col("_a.age") - F.col("_b.age")).alias("gap_ms"),
    )
    return out.filter((F.col("buy_exchange") != F.col("sell_exchange")) & (F.col("sell_price") > F.col("buy_price")))


def arbitrage(matches: DataFrame, fees_bps: float = 5.0, min_profit: float = 1e-4, min_notional: float = 1000.0) -> DataFrame:
    """Spread (infinite over a price of 0), profit and viability after fees for venue matches."""
    fee = fees_bps / 10000
    out = matches.withColumns(
        {
            "spread_bps": ieee_quotient(F.col("sell_price") - F.col("buy_price"), F.col("buy_price")) * 10000,
            "pnl": (F.col("sell_price") - F.col("buy_price")) * F.col("quantity"),
        }
    )
    return out.withColumn(
        "viable",
        (F.col("spread_bps") / 10000 - fee > 0) & (F.col("pnl") * (1 - fee) > min_profit)
        & (F.col("quantity") * F.col("buy_price") > min_notional),
    )


def assemble_features(values: DataFrame, names: Sequence[str], entity: str = "entity_id", ts: str = "ts",
                      feature: str = "feature", value: str = "value") -> DataFrame:
    """One wide row per (entity, ts) from long feature values."""
    return values.groupBy(entity, ts).pivot(feature, list(names)).agg(F.max(value))


def aligned_panel(df: DataFrame, assets: Sequence[str], value: str, ts: str = "ts", asset: str = "asset") -> DataFrame:
    """One column per asset and only times at which every asset has a value."""
    return df.groupBy(ts).pivot(asset, list(assets)).agg(F.max(value)).dropna()


def category_counts(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Counts of both samples per category, 0 where a side has none (a full outer alignment by union)."""
    both = ref.select(F.col(col).alias("category"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        cur.select(F.col(col).alias("category"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    return both.groupBy("category").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
