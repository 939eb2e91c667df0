"""Sources, sinks, lookups, projection, set operations and scalar functions."""

import pandas as pd
from pyspark.sql import functions as F

from quotemill.functions import scalars as S
from quotemill.operators import lookup as L
from quotemill.operators import project as P
from quotemill.operators.ordered import Panel
from quotemill.plans.market import BAR_SERIES, BARS, QUOTES, TICKS, symbol_bars
from quotemill.plans.registry import R, query, rnd, rounded
from quotemill.schemas import STREAM_TICK
from quotemill.session import scratch
from quotemill.sources import decode, points, store

ORDER_COLS = "o_orderkey, o_custkey, o_totalprice, o_orderpriority"


# -- files -----------------------------------------------------------------------------------------------


for _fmt in ("csv", "json", "parquet"):
    @query(f"export_import_{_fmt}", "SELECT event_id, ts, user_id, event_type, value FROM events "
           "WHERE event_type IN ('click', 'view') AND value >= 10 AND value <= 90")
    def _roundtrip(t, fmt=_fmt):
        path = scratch(t.spark, "export") + "." + fmt
        events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
        store.export_table(events, path, {"event_type": ["click", "view"], "value": (10.0, 90.0)})
        return store.read_table(t.spark, path, events.schema)


@query("partitioned_by_day", "SELECT event_id, event_type, value FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-07'")
def _by_day(t):
    path = scratch(t.spark, "by-day")
    store.write_partitioned(t.events, path, store.layout("time"), spread=("event_type", "ts"), files_per_key=2)
    return store.scan_partitions(t.spark, path, part="2024-01-07").select("event_id", "event_type", "value")


@query("partitioned_by_symbol", f"WITH {TICKS} SELECT symbol, count(*) AS n, sum(volume) AS volume FROM ticks WHERE symbol = 'view' GROUP BY 1")
def _by_symbol(t):
    path = scratch(t.spark, "by-symbol")
    store.write_partitioned(t.ticks, path, store.layout("symbol"), files_per_key=4)
    return store.scan_partitions(t.spark, path, part="view").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("partitioned_by_hash", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks GROUP BY 1")
def _by_hash(t):
    path = scratch(t.spark, "by-hash")
    store.write_partitioned(t.ticks, path, store.layout("hash", buckets=8), files_per_key=2)
    return t.spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("partitioned_composite", f"""WITH {TICKS} SELECT strftime(ts, '%Y-%m-%d-%H') || '|' || symbol AS part, count(*) AS n
FROM ticks GROUP BY 1""")
def _composite(t):
    key = store.layout("composite", unit="hour")
    return t.ticks.groupBy(key.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("partition_tags", f"""WITH {TICKS} SELECT strftime(ts, '%Y-%m-%d') AS tag_day, strftime(ts, '%H') AS tag_hour,
  strftime(ts, '%G-W%V') AS tag_week, symbol AS tag_asset, count(*) AS n FROM ticks GROUP BY 1, 2, 3, 4""")
def _tags(t):
    tags = store.partition_tags()
    return t.ticks.groupBy(*[v.alias("tag" + k[1:]) for k, v in tags.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("drop_internal_columns", "SELECT event_id, event_type FROM events")
def _internal(t):
    return store.drop_internal(t.events.select("event_id", "event_type", "ts").withColumns(store.partition_tags("ts", "event_type"))).drop("ts")


@query("upsert_ticks", f"""WITH {TICKS}, u AS (SELECT *, price * 1.5 AS np FROM ticks WHERE volume > 60)
SELECT t.symbol, t.exchange, t.ts, {R('coalesce(u.np, t.price)')} AS price FROM ticks t LEFT JOIN u USING (tie)""")
def _upsert(t):
    path = scratch(t.spark, "upsert")
    ticks = t.ticks.select("symbol", "exchange", "ts", "price", "volume", "tie").withColumn("part", S.time_key("ts", "day"))
    ticks.repartition("part").write.partitionBy("part").parquet(path)
    stale = ticks.filter("volume > 60").withColumn("seq", F.lit(1)).withColumn("price", F.col("price") * 1.2)
    fresh = ticks.filter("volume > 60").withColumn("seq", F.lit(2)).withColumn("price", F.col("price") * 1.5)
    latest = store.latest_per_key(stale.unionByName(fresh), ["symbol", "exchange", "ts", "tie"], ["seq"]).drop("seq")
    store.upsert(t.spark, path, latest, ["symbol", "exchange", "ts", "tie"], ["price"])
    return rounded(t.spark.read.schema(ticks.schema).parquet(path).select("symbol", "exchange", "ts", "price"))


@query("upsert_new_keys_only", f"WITH {TICKS} SELECT symbol, tie, price FROM ticks WHERE volume <= 30")
def _newkeys(t):
    have = t.ticks.filter("volume > 30")
    return store.new_keys_only(t.ticks, have, ["tie"]).select("symbol", "tie", "price")


@query("range_delete", f"""WITH {TICKS} SELECT tie, symbol, price FROM ticks
WHERE NOT (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00' AND symbol = 'click')""")
def _range_delete(t):
    path = scratch(t.spark, "delete")
    t.ticks.withColumn("part", S.time_key("ts", "day")).repartition("part").write.partitionBy("part").parquet(path)
    cond = store.range_predicate("ts", "2024-01-10", "2024-01-12 12:00:00", F.col("symbol") == "click")
    store.delete_where(t.spark, path, cond)
    return t.spark.read.parquet(path).select("tie", "symbol", "price")


@query("append_then_delete_by_id", f"WITH {TICKS} SELECT tie, symbol FROM ticks WHERE price >= 6")
def _append(t):
    path = scratch(t.spark, "append")
    ticks = t.ticks.select("tie", "symbol", "price", S.time_key("ts", "day").alias("part"))
    ticks.filter("price < 50").repartition("part").write.partitionBy("part").parquet(path)
    ticks.filter("price >= 50").repartition("part").write.mode("append").partitionBy("part").parquet(path)
    store.delete_where(t.spark, path, F.col("price") < 6)
    return t.spark.read.parquet(path).select("tie", "symbol")


@query("compact_bar_pages", f"WITH {BARS} SELECT symbol, ts, open, close, volume FROM bars")
def _compact(t):
    bars = t.bars.select("symbol", "ts", "open", "close", "volume")
    pages = [bars.filter("hour(ts) < 14"), bars.filter("hour(ts) >= 10")]
    return store.compact(pages, ["symbol", "ts"])


@query("multi_symbol_bars", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol IN ('click', 'view', 'error')")
def _multi(t):
    wanted = t.ticks.filter(F.col("symbol").isin("click", "view", "error"))
    return symbol_bars(wanted).select("symbol", "ts", "open", "high", "low", "close", "volume")


# -- lookups ---------------------------------------------------------------------------------------------


@query("tick_query_builder", f"""WITH {TICKS} SELECT symbol, exchange, count(*) AS n, {R('avg(price)')} AS avg_price FROM ticks
WHERE volume > 20 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2 ORDER BY n DESC, symbol, exchange LIMIT 15 OFFSET 2""")
def _builder(t):
    q = L.TickQuery(t.ticks).filter(F.col("volume") > 20).time_range("2024-01-03", "2024-01-20")
    q.group_by("symbol", "exchange", n=F.count(F.lit(1)), avg_price=rnd(F.avg("price")))
    return q.order_by("n", desc=True).order_by("symbol", "exchange").limit(15).offset(2).build()


@query("get_ticks", f"""WITH {TICKS} SELECT tie, ts, price FROM ticks WHERE symbol = 'click' AND exchange = 'v1'
AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-28' ORDER BY ts DESC, tie DESC LIMIT 100 OFFSET 20""")
def _get_ticks(t):
    return L.get_ticks(t.ticks, "click", "v1", "2024-01-02", "2024-01-28", skip=20).select("tie", "ts", "price")


@query("ticks_in_price_range", f"""WITH {TICKS} SELECT tie, price FROM ticks WHERE symbol = 'view' AND price BETWEEN 20 AND 30
ORDER BY ts DESC, tie DESC LIMIT 50""")
def _price_range(t):
    return L.get_ticks(t.ticks, "view", limit=50, price=(20.0, 30.0)).select("tie", "price")


@query("tick_by_id", f"WITH {TICKS} SELECT tie, symbol, price FROM ticks WHERE tie = 77")
def _by_id(t):
    return L.by_id(t.ticks, 77).select("tie", "symbol", "price")


@query("latest_ticks", f"WITH {TICKS} SELECT symbol, exchange, max(ts) AS ts, arg_max(price, (ts, tie)) AS price FROM ticks GROUP BY 1, 2")
def _latest(t):
    return L.latest_ticks(t.ticks).select("symbol", "exchange", "ts", "price")


@query("newest_trades", f"""WITH {TICKS} SELECT tie, ts, price, volume FROM ticks WHERE symbol = 'error' AND ts <= TIMESTAMP '2024-01-22'
ORDER BY ts DESC, tie DESC LIMIT 200""")
def _newest(t):
    return L.newest(t.ticks, 200, end="2024-01-22", symbol="error").select("tie", "ts", "price", "volume")


@query("paged_search", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _paged(t):
    df = t.orders.withColumn("neg", -F.col("o_totalprice"))
    return L.page(df, F.col("o_orderstatus") == "F", ["neg", "o_orderkey"], 3, 25).select("o_orderkey", "o_totalprice")


@query("ordered_limit_offset", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 10")
def _ordered(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(40).select("c_custkey", "c_name", "c_acctbal")


# -- points ----------------------------------------------------------------------------------------------


def _points(t):
    ticks = t.ticks.withColumn("levels", F.array("price", "volume"))
    return points.to_points(ticks, "tick", ["symbol", "exchange"], ["price", "volume", "levels"])


@query("write_points", f"""WITH {TICKS} SELECT 'tick' AS measurement, symbol, exchange, ts AS time, price,
  '[' || CAST(price AS VARCHAR) || ',' || CAST(volume AS VARCHAR) || ']' AS levels_json FROM ticks""")
def _write_points(t):
    return _points(t).select("measurement", F.element_at("tags", "symbol").alias("symbol"), F.element_at("tags", "exchange").alias("exchange"),
                             "time", "fields.price", "fields.levels_json")


@query("point_introspection", f"""WITH {TICKS} SELECT 'tag value' AS kind, symbol AS name FROM ticks GROUP BY ALL
UNION ALL SELECT * FROM (VALUES ('field', 'price double'), ('field', 'volume double'), ('field', 'levels_json string'),
  ('tag', 'symbol'), ('tag', 'exchange'), ('measurement', 'tick'))""")
def _introspect(t):
    p = _points(t)
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), c.alias("name"))
    return P.concat([
        kind(points.tag_values(p, "symbol"), "tag value", F.col("value")),
        kind(points.field_keys(p), "field", F.concat_ws(" ", "field", "type")),
        kind(points.tag_keys(p), "tag", F.col("tag")),
        kind(points.measurements(p), "measurement", F.col("measurement")),
    ])


@query("series_cardinality", f"WITH {TICKS} SELECT 'tick' AS measurement, count(*) AS series FROM (SELECT DISTINCT symbol, exchange FROM ticks)")
def _cardinality(t):
    return points.series_cardinality(_points(t))


@query("database_statistics", f"""WITH {TICKS} SELECT 'tick' AS measurement, count(*) AS points,
  CAST(date_diff('day', min(ts), max(ts)) + 1 AS BIGINT) AS days, count(DISTINCT symbol || exchange) AS series FROM ticks""")
def _dbstats(t):
    return points.statistics(_points(t))


@query("retention_statistics", f"""WITH {TICKS} SELECT 'tick' AS measurement, 864000 AS keep_seconds, count(*) AS points, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS expired,
  min(ts) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS oldest_kept FROM ticks""")
def _retention(t):
    policies = t.spark.createDataFrame([("tick", 864000), ("book", None)], "measurement string, keep_seconds int")
    return points.retention_report(_points(t), policies, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("newest_book_snapshots", f"""WITH {TICKS} SELECT tie, ts, {R('price * 0.999')} AS best_bid, {R('price * 1.001')} AS best_ask, 6 * volume + 21 AS bid_size, 6 * (100 - volume) + 21 AS ask_size
FROM ticks WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, tie DESC LIMIT 150""")
def _newest_books(t):
    """The newest snapshots of a book in a range, read from a table of books by day."""
    from quotemill.plans.micro_queries import level_books

    path = scratch(t.spark, "books")
    store.write_partitioned(level_books(t), f"{path}/books", store.layout("time"), files_per_key=2)
    books = L.newest(store.scan_partitions(t.spark, f"{path}/books"), 150, "2024-01-05", "2024-01-25", symbol="click")
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda x, y: x + y["size"])
    return books.select("tie", "ts", rnd(F.element_at("bids", 1)["price"]).alias("best_bid"), rnd(F.element_at("asks", 1)["price"]).alias("best_ask"),
                        total("bids").alias("bid_size"), total("asks").alias("ask_size"))


# -- decoding --------------------------------------------------------------------------------------------


def _payloads(t):
    """Broker-like rows: JSON text of every tick; rows with no volume carry a cut-off payload."""
    ticks = t.ticks.select("tie", F.to_json(F.struct(
        "symbol", "price", F.col("volume").cast("long").alias("volume"), "exchange", F.col("ts").cast("string").alias("timestamp"),
        F.col("tie").cast("string").alias("trade_id"), F.array(F.lit("regular")).alias("conditions"))).alias("json"), "volume")
    return ticks.select("tie", F.when(F.col("volume") == 0, F.substring("json", 1, 20)).otherwise(F.col("json")).alias("value"))


@query("decode_ticks", f"""WITH {TICKS} SELECT tie, symbol, price, CAST(volume AS BIGINT) AS volume, exchange, ts AS timestamp,
  CAST(tie AS VARCHAR) AS trade_id, NULL::VARCHAR AS side, 'regular' AS condition FROM ticks WHERE volume > 0""")
def _decode(t):
    d = decode.decode_ticks(_payloads(t))
    return d.withColumn("condition", F.element_at("conditions", 1)).drop("conditions")


@query("decode_errors_kept", f"WITH {TICKS} SELECT count(*) FILTER (volume = 0) AS bad, count(*) FILTER (volume > 0) AS good FROM ticks")
def _decode_errors(t):
    d = decode.decode_json(_payloads(t), STREAM_TICK, keep_errors=True)
    return d.agg(F.count_if(F.col(decode.CORRUPT).isNotNull()).alias("bad"), F.count_if(F.col(decode.CORRUPT).isNull()).alias("good"))


@query("normalize_quotes", f"""WITH {QUOTES} SELECT tie, symbol, {R('bid')} AS bid, {R('ask')} AS ask, CASE WHEN bid_size > 50 THEN bid_size ELSE 0 END AS bid_size,
  0.0::DOUBLE AS ask_size, CASE WHEN bid_size > 20 THEN exchange ELSE 'unknown' END AS exchange FROM quotes WHERE bid_size > 10""")
def _normalize(t):
    fields = F.struct("symbol", F.when(F.col("bid_size") > 10, F.col("bid")).alias("bid"), "ask",
                      F.when(F.col("bid_size") > 50, F.col("bid_size")).alias("bid_size"),
                      F.when(F.col("bid_size") > 20, F.col("exchange")).alias("exchange"))
    q = decode.normalize_quotes(t.quotes.select("tie", F.to_json(fields).alias("value")))
    return rounded(q.select("tie", "symbol", "bid", "ask", "bid_size", "ask_size", "exchange"), 6, "bid", "ask")


@query("decode_raw_messages", """SELECT event_id, CASE WHEN value > 50 THEN props WHEN value > 20 THEN '{"raw":"' || event_type || '"}' ELSE '{"raw":"fffe"}' END AS message FROM events""")
def _raw(t):
    payload = F.when(F.col("value") > 50, F.col("props").cast("binary")).when(
        F.col("value") > 20, F.col("event_type").cast("binary")).otherwise(F.unhex(F.lit("FFFE")))
    return t.events.select("event_id", decode.decode_raw(payload).alias("message"))


@query("message_metadata", f"WITH {TICKS} SELECT exchange AS topic, count(*) AS n, max(tie) AS last_offset FROM ticks GROUP BY 1")
def _metadata(t):
    m = t.ticks.select(F.col("exchange").alias("topic"), F.lit(0).alias("partition"), F.col("tie").alias("offset"), F.col("ts").alias("timestamp"))
    m = m.select(decode.message_metadata().alias("m"))
    return m.groupBy("m.topic").agg(F.count(F.lit(1)).alias("n"), F.max("m.offset").alias("last_offset"))


# -- projection ------------------------------------------------------------------------------------------


@query("map_filter_chain", f"""WITH {TICKS} SELECT tie, symbol, {R('price * volume')} AS notional, {R('price * volume * 0.001')} AS fee
FROM ticks WHERE volume > 10 AND price * volume > 500""")
def _chain(t):
    chain = P.compose(
        lambda d: d.filter("volume > 10"),
        lambda d: P.map_columns(d, {"notional": F.col("price") * F.col("volume")}),
        lambda d: d.filter("notional > 500"),
        lambda d: d.withColumn("fee", F.col("notional") * 0.001),
    )
    return rounded(chain(t.ticks).select("tie", "symbol", "notional", "fee"))


def _log_price(b: pd.DataFrame) -> pd.DataFrame:
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):  # 0 gives -infinity, less NaN
        value = np.floor(np.log(b["price"].to_numpy(float)) * 1e6 + 0.4871) / 1e6
    return pd.DataFrame({"tie": b["tie"], "log_price": pd.arrays.FloatingArray(value, b["no_price"].to_numpy(bool))})


@query("parallel_map", f"WITH {TICKS} SELECT tie, {R('ln(price)')} AS log_price FROM ticks")
def _pmap(t):
    return P.map_batches(t.ticks.select("tie", "price", F.col("price").isNull().alias("no_price")), _log_price, "tie long, log_price double")


def _inverse(b: pd.DataFrame) -> pd.Series:
    if (b["volume"] == 0).any():
        raise ZeroDivisionError("no volume")
    return b["price"] / b["volume"]


@query("map_with_failing_items", f"""WITH {TICKS} SELECT tie, {R('price / nullif(volume, 0)')} AS unit,
  CASE WHEN volume = 0 THEN 'ZeroDivisionError: no volume' END AS error FROM ticks""")
def _failing(t):
    return rounded(P.map_or_error(t.ticks.select("tie", "price", "volume"), _inverse, "unit", "double", ["volume", "price"]).select("tie", "unit", "error"), 6, "unit")


@query("named_features", f"""WITH {TICKS} SELECT tie, {R('price / nullif(volume, 0)')} AS unit_price, {R('ln(price)')} AS log_price,
  {R('price * volume')} AS notional FROM ticks""")
def _named(t):
    features = {"unit_price": F.try_divide("price", "volume"), "log_price": S.ieee_log(F.col("price")), "notional": F.col("price") * F.col("volume")}
    return rounded(P.map_columns(t.ticks, features).select("tie", *features))


@query("named_feature_errors", f"""WITH {TICKS} SELECT tie, {R('CASE WHEN volume <> 0 THEN price / volume END')} AS unit_price, {R('CASE WHEN price >= 10 THEN sqrt(price - 10) END')} AS root,
  array_to_string(list_filter([CASE WHEN volume = 0 THEN 'unit_price=ZeroDivisionError: no volume' END, CASE WHEN price < 10 THEN 'root=ValueError: low price' END], lambda x: x IS NOT NULL), ';') AS errors FROM ticks""")
def _named_errors(t):
    """Two user functions that fail on some rows; each failure keeps its feature's name and message."""
    def unit_price(b):
        if (b["volume"] == 0).any():
            raise ZeroDivisionError("no volume")
        return b["price"] / b["volume"]

    def root(b):
        if (b["price"] < 10).any():
            raise ValueError("low price")
        return (b["price"] - 10) ** 0.5

    out = P.named_features(t.ticks.select("tie", "price", "volume"), {"unit_price": unit_price, "root": root},
                           {"unit_price": ["volume", "price"], "root": ["price"]})
    pairs = F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(F.when(e["key"] == "unit_price", "0").otherwise("1"), e["key"], F.lit("="), e["value"])))
    return rounded(out.select("tie", "unit_price", "root", F.array_join(F.transform(pairs, lambda x: F.substring(x, 2, 1000)), ";").alias("errors")), 6, "unit_price", "root")


@query("sql_entry", f"""WITH {TICKS} SELECT symbol, count(*) AS n, max(price) AS top FROM ticks WHERE volume >= 25 GROUP BY symbol""")
def _sql(t):
    return P.run_sql(t.spark, "SELECT symbol, count(*) AS n, max(price) AS top FROM tick_view WHERE volume >= :floor GROUP BY symbol",
                     {"tick_view": t.ticks}, floor=25)


@query("clean_numbers", f"WITH {TICKS} SELECT tie, {R('coalesce(CASE WHEN volume = 0 THEN 0 ELSE price / volume END, 0)')} AS x FROM ticks")
def _clean(t):
    d = t.ticks.withColumn("x", F.when(F.col("volume") == 0, F.lit(float("inf"))).otherwise(F.col("price") / F.nullif("volume", F.lit(0.0))))
    return rounded(d.select("tie", S.clean_number("x").alias("x")))


@query("drop_incomplete_rows", f"""WITH {BARS}, m AS (SELECT symbol, ts, close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts) AS momentum_10 FROM bars)
SELECT symbol, ts, {R('momentum_10')} AS momentum_10 FROM m WHERE momentum_10 IS NOT NULL""")
def _dropna(t):
    from quotemill.operators import rolling as X

    p = Panel(t.bars, BAR_SERIES)
    X.momentum(p, 10)
    return rounded(p.done().select("symbol", "ts", "momentum_10").dropna())


@query("calendar_features", f"""WITH {TICKS} SELECT tie, CAST(extract(hour FROM ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  CAST(month(ts) AS INT) AS month FROM ticks""")
def _calendar(t):
    return t.ticks.select("tie", *[v.alias(k) for k, v in S.calendar("ts").items()])


@query("range_and_null_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 90000 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'O'")
def _range(t):
    return t.orders.filter(S.matches({"o_totalprice": (1000.0, 90000.0), "o_orderpriority": ["1-URGENT", "5-LOW"], "o_orderstatus": "O"})).select("o_orderkey", "o_totalprice")


# -- sets ------------------------------------------------------------------------------------------------


@query("concatenate_tables", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def _concat(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return P.concat([a, b])


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _distinct(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("category_union_and_difference", f"""WITH {TICKS}, a AS (SELECT DISTINCT exchange AS x FROM ticks WHERE symbol = 'click'),
b AS (SELECT DISTINCT symbol AS x FROM ticks)
SELECT 'union' AS kind, x FROM (SELECT x FROM a UNION SELECT x FROM b) UNION ALL SELECT 'only first', x FROM (SELECT x FROM a EXCEPT SELECT x FROM b)""")
def _sets(t):
    a = t.ticks.filter("symbol = 'click'").select(F.col("exchange").alias("x")).distinct()
    b = t.ticks.select(F.col("symbol").alias("x")).distinct()
    return a.union(b).distinct().select(F.lit("union").alias("kind"), "x").unionByName(a.exceptAll(b).select(F.lit("only first").alias("kind"), "x"))


@query("distinct_tag_values", f"WITH {TICKS} SELECT DISTINCT exchange AS value FROM ticks")
def _tag_values(t):
    return points.tag_values(_points(t), "exchange")


# -- scalar functions ------------------------------------------------------------------------------------


@query("time_buckets", f"""WITH {TICKS} SELECT tie, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week,
  strftime(ts, '%Y-%m-%d-%H-%M') AS minute_key, strftime(ts, '%G-W%V') AS week_key FROM ticks""")
def _buckets(t):
    from quotemill.operators.bars import bucket

    return t.ticks.select("tie", bucket("ts", "15m").alias("quarter"), bucket("ts", "1w").alias("week"),
                          S.time_key("ts", "minute").alias("minute_key"), S.time_key("ts", "week").alias("week_key"))


@query("parse_times", f"WITH {TICKS} SELECT tie, ts AS a, time_bucket(INTERVAL 1 SECOND, ts) AS b, ts AS c FROM ticks")
def _parse(t):
    from quotemill.operators.ordered import epoch_us

    us = epoch_us("ts")
    d = t.ticks.select("tie", F.col("ts").cast("string").alias("iso"), F.floor(us / 1000000).cast("string").alias("sec"), us.cast("string").alias("us"))
    return d.select("tie", S.parse_time("iso").alias("a"), S.parse_time("sec").alias("b"), S.parse_time("us").alias("c"))


@query("duration_filter", f"WITH {TICKS} SELECT tie FROM ticks WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 5 DAY - INTERVAL 90 MINUTE")
def _duration(t):
    cut = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - S.interval("5d1h30m")
    return t.ticks.filter(F.col("ts") >= cut).select("tie")


@query("rounding_and_clipping", f"""WITH {QUOTES} SELECT tie, {R('round(bid / 0.25) * 0.25')} AS aligned, least(greatest(bid, 10.0), 90.0) > 89.9 AS capped,
  {R('sqrt(abs(bid - ask))')} AS root, greatest(bid_size, ask_size) AS larger FROM quotes""")
def _round(t):
    q = t.quotes.select("tie", rnd(S.tick_align("bid", 0.25)).alias("aligned"), (S.clip("bid", 10.0, 90.0) > 89.9).alias("capped"),
                        rnd(F.sqrt(F.abs(F.col("bid") - F.col("ask")))).alias("root"), F.greatest("bid_size", "ask_size").alias("larger"))
    return q


@query("json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS encoded FROM events")
def _json(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("encoded"))


@query("array_functions", """SELECT vec_id, """ + R("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))") + """ AS norm2,
  CAST(len(embedding) AS INT) AS n, """ + R("CAST(list_max(embedding[1:8]) AS DOUBLE)") + " AS top8 FROM embeddings")
def _arrays(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", rnd(F.aggregate(F.zip_with(e, e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)).alias("norm2"),
                               F.size("embedding").alias("n"), rnd(F.array_max(F.slice(e, 1, 8))).alias("top8"))


@query("tag_maps", f"WITH {TICKS} SELECT tie, symbol, exchange, 'tick' AS source FROM ticks")
def _maps(t):
    m = F.map_concat(F.create_map(F.lit("symbol"), F.col("symbol"), F.lit("exchange"), F.col("exchange")), F.create_map(F.lit("source"), F.lit("tick")))
    return t.ticks.select("tie", m.alias("m")).select("tie", *[F.element_at("m", k).alias(k) for k in ("symbol", "exchange", "source")])


@query("text_matching", "SELECT p_partkey, regexp_matches(p_name, '^(small|large) ') AS sized, contains(lower(p_name), 'widget') AS widget, lower(p_name) LIKE 'red %' AS red FROM part")
def _text(t):
    return t.part.select("p_partkey", F.col("p_name").rlike("^(small|large) ").alias("sized"), S.contains_text("p_name", "WIDGET").alias("widget"), S.wildcard("p_name", "RED *").alias("red"))


@query("record_checksums", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS sha, md5('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS digest FROM customer""")
def _checksum(t):
    return t.customer.select("c_custkey", S.record_checksum(t.customer, ["c_name", "c_custkey"]).alias("sha"),
                             S.record_checksum(t.customer, ["c_name", "c_custkey"], "md5").alias("digest"))


@query("hash_buckets", "SELECT count(*) AS n, true AS inside, true AS stable FROM events")
def _hash(t):
    d = t.events.withColumn("b", S.hash_bucket(16, "event_id")).withColumn("b2", S.hash_bucket(16, "event_id"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("b") >= 0) & (F.col("b") < 16)).alias("inside"), F.bool_and(F.col("b") == F.col("b2")).alias("stable"))


@query("symbol_names", f"WITH {TICKS} SELECT DISTINCT upper(symbol) || '/' || upper(exchange) AS pair FROM ticks")
def _names(t):
    return t.ticks.select(S.normalize_symbol(F.concat_ws("-", "symbol", "exchange")).alias("pair")).distinct()


@query("alert_messages", f"WITH {TICKS} SELECT tie, 'High price for ' || symbol || ' on ' || exchange || ': ' || CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) AS text FROM ticks WHERE price > 95")
def _messages(t):
    hot = t.ticks.filter("price > 95").withColumn("whole", F.floor("price"))
    return hot.select("tie", S.message("High price for {symbol} on {exchange}: {whole}").alias("text"))
