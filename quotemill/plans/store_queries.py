"""Feature store, learning, versions, lineage, retention, user-defined functions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quotemill.functions import user as U
from quotemill.functions.scalars import time_key
from quotemill.operators import governance as G
from quotemill.operators import learning as L
from quotemill.operators import regimes as H
from quotemill.operators import rolling as X
from quotemill.operators.feature_store import FeatureStore
from quotemill.operators.ordered import Panel, Series
from quotemill.operators.regimes import Chain
from quotemill.plans.market import BAR_SERIES, BARS, RETURN_SERIES, RETURNS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rounded
from quotemill.session import materialize, scratch

FEATURES = ["click", "view", "error"]
VALUES = "fv AS (SELECT event_type AS feature, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS version, CAST(user_id AS VARCHAR) AS entity_id, ts, value, event_id FROM events WHERE event_type IN ('click', 'view', 'error'))"


def values(t):
    return t.events.filter(F.col("event_type").isin(FEATURES)).select(
        F.col("event_type").alias("feature"), F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), 1).otherwise(2).alias("version"),
        F.col("user_id").cast("string").alias("entity_id"), "ts", "value")


def feature_store(t) -> FeatureStore:
    """Three features with two versions each; version 1 of every feature is in production."""
    fs = FeatureStore(t.spark, scratch(t.spark, "feature-store"))
    fs.register_all([(f, v, status, f"value of {f} events", "double", ["event", "slow" if f == "error" else "fast"], seq)
                     for f in FEATURES for v, status, seq in ((1, "draft", 0), (2, "draft", 0), (1, "production", 1))])
    fs.write(values(t))
    return fs


@query("feature_catalogue", f"WITH {VALUES} SELECT feature, CAST(version AS INT) AS version, CASE WHEN version = 1 THEN 'production' ELSE 'draft' END AS status, count(*) AS n FROM fv GROUP BY feature, fv.version")
def _catalogue(t):
    fs = feature_store(t)
    n = fs.read(FEATURES).groupBy("feature", "version").agg(F.count(F.lit(1)).alias("n"))
    return fs.metadata().join(n, ["feature", "version"]).select("feature", "version", "status", "n")


@query("feature_search", f"WITH {VALUES} SELECT feature, CAST(version AS INT) AS version, count(*) AS n FROM fv WHERE feature IN ('click', 'view') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 2 OFFSET 2")
def _search(t):
    fs = feature_store(t)
    n = fs.read(FEATURES).groupBy("feature", "version").agg(F.count(F.lit(1)).alias("n"))
    return fs.search(text="EVENTS", name="*i*", tags=["fast"], page=2, size=2).join(n, ["feature", "version"]).select("feature", "version", "n")


@query("feature_values", f"WITH {VALUES} SELECT feature, entity_id, ts, value FROM fv WHERE feature = 'click' AND entity_id IN ('3', '14', '15') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'")
def _values(t):
    return feature_store(t).read(["click"], ["3", "14", "15"], "2024-01-05", "2024-01-25").select("feature", "entity_id", "ts", "value")


@query("feature_values_newest", f"WITH {VALUES} SELECT feature, entity_id, ts, value FROM fv WHERE feature = 'view' ORDER BY ts DESC, feature, entity_id LIMIT 50")
def _newest(t):
    return feature_store(t).read(["view"], limit=50).select("feature", "entity_id", "ts", "value")


@query("feature_set_read", f"WITH {VALUES} SELECT entity_id, ts, " + ", ".join(f"max(value) FILTER (feature = '{f}') AS \"{f}\"" for f in FEATURES) + " FROM fv WHERE version = 1 GROUP BY 1, 2")
def _set(t):
    return feature_store(t).read_set(FEATURES, production=True)


@query("feature_lookup", f"WITH {VALUES}, rq AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS entity_id, ts FROM events WHERE event_type = 'purchase') SELECT rq.request_id, rq.entity_id, " + ", ".join(
    f"(SELECT arg_max(fv.value, fv.ts) FROM fv WHERE fv.feature = '{f}' AND fv.version = 1 AND fv.entity_id = rq.entity_id AND fv.ts <= rq.ts) AS \"{f}\"" for f in FEATURES) + " FROM rq")
def _lookup(t):
    requests = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("entity_id"), "ts")
    return feature_store(t).lookup(requests, FEATURES, production=True).drop("ts")


@query("feature_versions_resolved", f"WITH {VALUES} SELECT feature, CAST(max(version) AS INT) AS latest, CAST(min(version) AS INT) AS production FROM fv GROUP BY 1")
def _resolve(t):
    fs = feature_store(t)
    a, b = fs.resolve().withColumnRenamed("version", "latest"), fs.resolve(True).withColumnRenamed("version", "production")
    seen = fs.read(FEATURES).select("feature").distinct()
    return a.join(b, "feature").join(seen, "feature", "left_semi")


@query("feature_statistics", f"WITH {VALUES} SELECT feature, CAST(version AS INT) AS version, count(value) AS count, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, {R('skewness(value)', 5)} AS skew, "
       + ", ".join(f"{R(f'quantile_cont(value, {q})')} AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM fv GROUP BY 1, 2")
def _stats(t):
    s = feature_store(t).statistics().drop("min", "max", "kurtosis")
    return rounded(rounded(s, 5, "skew"), 6, "mean", "std", "p25", "p50", "p75", "p95", "p99")


@query("feature_delete", f"WITH {VALUES} SELECT feature, CAST(version AS INT) AS version, count(*) AS n FROM fv WHERE NOT (feature = 'error' OR (feature = 'view' AND version = 2)) GROUP BY 1, 2")
def _delete(t):
    fs = feature_store(t)
    fs.delete("error")
    fs.delete("view", 2)
    n = fs.read(FEATURES).groupBy("feature", "version").agg(F.count(F.lit(1)).alias("n"))
    return fs.metadata().join(n, ["feature", "version"]).select("feature", "version", "n")


# -- learning --------------------------------------------------------------------------------------------

def labelled(t):
    p = Panel(t.bars, BAR_SERIES)
    X.pct_change(p)
    X.forward_label(p)
    X.candle_shape(p)
    X.momentum(p, 5)
    return materialize(p.done().dropna(subset=["returns_1", "momentum_5"]), "labelled")


@query("standard_scaling", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)')} AS l_quantity FROM lineitem")
def _scale(t):
    d = L.scaled(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_quantity"])
    return rounded(d, 6, "l_quantity")


@query("min_max_scaling", f"SELECT o_orderkey, {R('(o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)')} AS o_totalprice FROM orders")
def _minmax(t):
    return rounded(L.scaled(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax"), 6, "o_totalprice")


@query("time_ordered_split", f"WITH {TICKS}, i AS (SELECT symbol, tie, row_number() OVER (PARTITION BY symbol ORDER BY ts, tie) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks) SELECT symbol, tie, i < floor(n * 0.8) AS is_train FROM i")
def _split(t):
    return L.time_split(t.ticks, TICK_SERIES).select("symbol", "tie", "is_train")


FEATS = ["returns_1", "momentum_5", "volume", "range", "body"]


@query("train_random_forest")
def _forest(t):
    d = L.time_split(labelled(t), BAR_SERIES)
    model = L.train(d.filter("is_train"), FEATS)
    s = L.scores(model, d.filter("NOT is_train"), FEATS)
    rows = [("accuracy", s["accuracy"]), ("f1", s["f1"])] + [(f"importance of {n}", v) for n, v in L.importances(model, FEATS)]
    return t.spark.createDataFrame(rows, "name string, value double")


@query("train_boosted_trees")
def _boosted(t):
    d = L.time_split(labelled(t), BAR_SERIES)
    model = L.train(d.filter("is_train"), FEATS, kind="boosted", trees=5, depth=3)
    s = L.scores(model, d.filter("NOT is_train"), FEATS)
    return t.spark.createDataFrame(list(s.items()), "name string, value double")


@query("signals_from_saved_model")
def _signals(t):
    """Train, save, load, predict, and cut the class probabilities to signals."""
    from pyspark.ml import PipelineModel

    d = L.time_split(labelled(t), BAR_SERIES)
    path = scratch(t.spark, "model")
    L.train(d.filter("is_train"), FEATS).write().save(path)
    p = L.predict(PipelineModel.load(path), d.filter("NOT is_train"), FEATS)
    return p.select("symbol", "ts", "prediction", L.threshold_signal(threshold=0.5).alias("signal"))


@query("regime_mixture")
def _mixture(t):
    return L.mixture_regimes(t.daily_returns).groupBy("regime").agg(F.count(F.lit(1)).alias("days"), F.avg("ret").alias("mean_ret"))


# A chain of three states for the daily returns; fixed here so that the path can be recomputed.
CHAIN = Chain(np.array([0.3, 0.4, 0.3]), np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.25, 0.7]]), np.array([-0.3, 0.0, 0.4]), np.array([0.2, 0.15, 0.4]))


def _chain_sql(chain: Chain) -> dict[str, str]:
    b = [f"(-0.5 * pow((r.ret - ({m!r})) / {s!r}, 2) - ln({s!r}::DOUBLE) - 0.5 * ln(2 * pi()))" for m, s in zip(chain.mean.tolist(), chain.sd.tolist())]
    come = [[f"(f.d{i} + ln({float(chain.move[i, j])!r}::DOUBLE))" for i in range(3)] for j in range(3)]
    return {
        "first": ", ".join(f"ln({p!r}::DOUBLE) + {x} AS d{j}" for j, (p, x) in enumerate(zip(chain.start.tolist(), b))) + ", 0 AS p0, 0 AS p1, 0 AS p2",
        "next": ", ".join(f"greatest({', '.join(c)}) + {x}" for c, x in zip(come, b)) + ", "
        + ", ".join(f"CASE WHEN {c[0]} >= greatest({c[1]}, {c[2]}) THEN 0 WHEN {c[1]} >= {c[2]} THEN 1 ELSE 2 END" for c in come)}


_CHAIN_SQL = _chain_sql(CHAIN)


@query("regime_chain", f"""WITH RECURSIVE {RETURNS}, r AS MATERIALIZED (SELECT asset, ts, ret, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn FROM daily),
f AS (SELECT asset, rn, {_CHAIN_SQL['first']} FROM r WHERE rn = 1 UNION ALL SELECT r.asset, r.rn, {_CHAIN_SQL['next']} FROM f JOIN r ON r.asset = f.asset AND r.rn = f.rn + 1),
fm AS MATERIALIZED (SELECT * FROM f),
b AS (SELECT asset, rn, CASE WHEN d0 >= greatest(d1, d2) THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS state FROM fm QUALIFY row_number() OVER (PARTITION BY asset ORDER BY rn DESC) = 1
  UNION ALL SELECT b.asset, b.rn - 1, CASE b.state WHEN 0 THEN fm.p0 WHEN 1 THEN fm.p1 ELSE fm.p2 END FROM b JOIN fm ON fm.asset = b.asset AND fm.rn = b.rn WHERE b.rn > 1)
SELECT asset, ts, CAST(state AS INT) AS state, CASE state WHEN 0 THEN 'bear' WHEN 1 THEN 'sideways' ELSE 'bull' END AS regime FROM b JOIN r USING (asset, rn)""")
def _chain(t):
    """The likeliest path of regimes of every asset."""
    path = H.likeliest_path(t.daily_returns, RETURN_SERIES, "ret", CHAIN, block=64)
    return path.select("asset", "ts", "state", F.element_at(F.array(*[F.lit(x) for x in H.REGIMES]), F.col("state") + 1).alias("regime"))


# -- versions and lineage --------------------------------------------------------------------------------


@query("dataset_checksum", "SELECT true AS same_in_any_order, true AS changed_by_one_value, true AS changed_by_moved_nulls, count(*) AS rows FROM orders")
def _checksum(t):
    o = t.orders
    a, b = G.table_checksum(o), G.table_checksum(o.repartition(7, "o_custkey").sort("o_totalprice"))
    top = o.agg(F.max("o_orderkey").alias("k"))
    other = G.table_checksum(o.join(F.broadcast(top), o["o_orderkey"] == top["k"], "left").withColumn(
        "o_totalprice", F.when(F.col("k").isNotNull(), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("k"))
    pair = [o.select(F.when(F.lit(k), F.col("o_orderkey")).alias("x"), F.when(~F.lit(k), F.col("o_orderkey")).alias("y")) for k in (True, False)]
    left, right = (G.table_checksum(d).withColumnRenamed("checksum", n) for d, n in zip(pair, "de"))
    return (a.join(b.withColumnRenamed("checksum", "b"), "rows").join(other.withColumnRenamed("checksum", "c"), "rows").join(left, "rows").join(right, "rows")
            .select((F.col("checksum") == F.col("b")).alias("same_in_any_order"), (F.col("checksum") != F.col("c")).alias("changed_by_one_value"),
                    (F.col("d") != F.col("e")).alias("changed_by_moved_nulls"), "rows"))


@query("dataset_versions", "SELECT 'customers' AS dataset_id, 'filter' AS operation, count(*) AS rows FROM customer WHERE c_acctbal > 0")
def _versions(t):
    first = G.version_rows(t.customer, "customers", "ingest", "2024-01-01", tags=["raw"])
    second = G.version_rows(t.customer.filter("c_acctbal > 0"), "customers", "filter", "2024-01-02", parents=["customers-1"], tags=["clean", "daily"])
    third = G.version_rows(t.supplier, "suppliers", "ingest", "2024-01-03", tags=["raw", "daily"])
    v = first.unionByName(second).unionByName(third)
    return G.list_versions(v, "customers", any_tag=["daily", "weekly"], all_tags=["clean"]).select("dataset_id", "operation", "rows")


GRAPH = """e AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region)"""


def edges(t):
    """Orders come from customers, customers and suppliers from nations, nations from regions; a self-loop per region."""
    def link(df, a, ka, b, kb):
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))

    return (link(t.orders, "order:", "o_orderkey", "customer:", "o_custkey").unionByName(link(t.customer, "customer:", "c_custkey", "nation:", "c_nationkey"))
            .unionByName(link(t.supplier, "supplier:", "s_suppkey", "nation:", "s_nationkey")).unionByName(link(t.nation, "nation:", "n_nationkey", "region:", "n_regionkey"))
            .unionByName(link(t.region, "region:", "r_regionkey", "region:", "r_regionkey")))


@query("lineage_descendants", f"WITH RECURSIVE {GRAPH}, r AS (SELECT 'region:1' AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 10 AND e.src <> e.dst) SELECT node, CAST(min(depth) AS INT) AS depth FROM r WHERE depth > 0 GROUP BY 1")
def _descendants(t):
    start = t.region.filter("r_regionkey = 1").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.reachable(edges(t), start, 10, backwards=True)


@query("lineage_ancestors", f"WITH RECURSIVE {GRAPH}, r AS (SELECT src AS node, 0 AS depth FROM e WHERE src LIKE 'order:%' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2 AND e.src <> e.dst) SELECT node, CAST(min(depth) AS INT) AS depth FROM r WHERE depth > 0 GROUP BY 1")
def _ancestors(t):
    start = t.orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))
    return G.reachable(edges(t), start, 2)


@query("lineage_report", f"""WITH RECURSIVE {GRAPH}, r AS (SELECT 'region:2' AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 10 AND e.src <> e.dst),
u AS (SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1), en AS (SELECT 'customer:' || c_custkey AS node, 'customer' AS kind, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS quality FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_acctbal FROM supplier)
SELECT CAST(depth AS INT) AS depth, count(*) AS entities, count(DISTINCT kind) AS kinds, {R('avg(quality)', 4)} AS mean_quality, {R('count(quality) * 1.0 / count(*)')} AS completeness FROM u JOIN en USING (node) GROUP BY 1""")
def _report(t):
    start = t.region.filter("r_regionkey = 2").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    up = G.reachable(edges(t), start, 10, backwards=True)
    updated = F.lit("2024-01-01").cast("timestamp_ntz").alias("updated")
    en = t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"), F.lit("customer").alias("kind"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("quality"), updated)
    en = en.unionByName(t.supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("quality"), updated))
    rep = G.lineage_report(up, en, F.lit("2024-01-02").cast("timestamp_ntz")).select("depth", "entities", "kinds", "mean_quality", "completeness")
    return rounded(rounded(rep, 4, "mean_quality"), 6, "completeness")


@query("operation_history", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 3")
def _ops(t):
    s = Series(keys=("o_custkey",), ts="o_orderdate", tie=("o_orderkey",))
    return G.operation_history(t.orders, s, 3).select("o_custkey", "o_orderkey", "rank")


@query("retention_by_age", f"WITH {TICKS} SELECT CASE WHEN ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY THEN 'expired' ELSE 'kept' END AS part, count(*) AS n FROM ticks GROUP BY 1")
def _age(t):
    kept, gone = G.retain(t.ticks, "ts", "10d", F.lit("2024-01-31").cast("timestamp_ntz"))
    count = lambda d, n: d.groupBy(F.lit(n).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return count(kept, "kept").unionByName(count(gone, "expired"))


@query("retention_by_count", f"WITH {TICKS} SELECT symbol, tie FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, tie DESC) <= 500")
def _count(t):
    return G.retain_newest(t.ticks, TICK_SERIES, 500).select("symbol", "tie")


@query("retention_tiers", f"WITH {TICKS} SELECT CASE WHEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN 'hot' WHEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM ticks GROUP BY 1")
def _tiers(t):
    tier = G.tier("ts", F.lit("2024-01-31").cast("timestamp_ntz"), [("hot", "2d"), ("warm", "2w")])
    return t.ticks.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("retention_archive", f"WITH {TICKS} SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'archive' ELSE 'table' END AS place, count(*) AS n FROM ticks GROUP BY 1")
def _archive(t):
    path, old = scratch(t.spark, "retained"), scratch(t.spark, "archive")
    t.ticks.withColumn("part", time_key("ts", "day")).repartition("part").write.partitionBy("part").parquet(path)
    G.archive(t.spark, path, old, F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), run="2024-01-20")
    count = lambda p, n: t.spark.read.parquet(p).groupBy(F.lit(n).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return count(path, "table").unionByName(count(old, "archive"))


@query("retention_policies", f"""WITH {TICKS} SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'archive' ELSE 'table' END AS place, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-21') AS priced
FROM ticks WHERE ts >= TIMESTAMP '2024-01-06' GROUP BY 1""")
def _policies(t):
    """Delete after 25 days, archive after 20, blank prices after 10, in this order."""
    path, old = scratch(t.spark, "policies"), scratch(t.spark, "policies-archive")
    t.ticks.withColumn("part", time_key("ts", "day")).repartition("part").write.partitionBy("part").parquet(path)
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    G.apply_policies(t.spark, path, [("delete", "25d", {}), ("archive", "20d", {"archive_path": old, "run": "2024-01-31"}), ("blank", "10d", {"columns": ["price"]})], now)
    recent = F.count_if(F.col("price").isNotNull() & (F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz")))
    count = lambda p, n: t.spark.read.parquet(p).groupBy(F.lit(n).alias("place")).agg(F.count(F.lit(1)).alias("n"), recent.alias("priced"))
    return count(path, "table").unionByName(count(old, "archive"))


@query("cached_result", f"WITH {BARS} SELECT symbol, count(*) AS bars, max(high) AS top FROM bars GROUP BY 1")
def _cached(t):
    """A stored intermediate read by two consumers."""
    bars = materialize(t.bars, "cached")
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).join(bars.groupBy("symbol").agg(F.max("high").alias("top")), "symbol")


# -- user-defined functions ------------------------------------------------------------------------------


def _spread_bps(bid: pd.Series, ask: pd.Series) -> pd.Series:
    return (ask - bid) / bid * 10000


@query("scalar_function_in_sql", f"WITH {TICKS} SELECT symbol, {R('avg((price * 1.001 - price * 0.999) / (price * 0.999) * 10000)', 4)} AS bps FROM ticks GROUP BY 1")
def _scalar(t):
    U.register_scalar(t.spark, "spread_bps", _spread_bps, "double")
    t.ticks.createOrReplaceTempView("tick_view")
    out = t.spark.sql("SELECT symbol, avg(spread_bps(price * 0.999, price * 1.001)) AS bps FROM tick_view GROUP BY symbol")
    return rounded(out, 4)


ARRAYS = "(SELECT vec_id, list_transform(embedding[1:16], lambda x: 100 + CAST(x AS DOUBLE)) AS p, list_transform(embedding[17:32], lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings)"


@query("array_function", f"SELECT vec_id, {R('list_sum(list_transform(list_zip(p, v), lambda x: x[1] * x[2])) / list_sum(v)')} AS vwap FROM {ARRAYS}")
def _array(t):
    p = F.transform(F.slice("embedding", 1, 16), lambda x: 100 + x.cast("double"))
    v = F.transform(F.slice("embedding", 17, 16), lambda x: F.abs(x.cast("double")))
    return rounded(t.embeddings.select("vec_id", p.alias("p"), v.alias("v")).select("vec_id", U.array_vwap("p", "v").alias("vwap")))


@query("user_fold", f"WITH m AS (SELECT event_type, max(value) AS top FROM events GROUP BY 1) SELECT event_type, {R('any_value(top) + ln(sum(exp(value - top)))')} AS folded FROM events JOIN m USING (event_type) GROUP BY 1")
def _fold(t):
    """Logarithm of the summed exponentials, as pairs of the largest value and the sum scaled by it."""
    def merge(a, b):
        top = np.maximum(a[:, 0], b[:, 0])
        return np.column_stack([top, a[:, 1] * np.exp(a[:, 0] - top) + b[:, 1] * np.exp(b[:, 0] - top)])

    out = U.fold(t.events, ["event_type"], "value", lambda x: np.column_stack([x, np.ones_like(x)]), merge, 2, lambda s: s[:, 0] + np.log(s[:, 1]))
    return rounded(out)


@query("table_function", f"WITH {TICKS} SELECT tie, CAST(j AS INT) AS level, {R('price * (1 - j / 1000.0)')} AS price, volume + j AS size FROM ticks, (SELECT unnest([1, 2, 3]) AS j)")
def _table(t):
    U.register_table_functions(t.spark)
    t.ticks.createOrReplaceTempView("tick_view")
    return rounded(t.spark.sql("SELECT t.tie, l.level, l.price, l.size FROM tick_view t, LATERAL book_levels(t.price, t.volume, 3) l"), 6, "price")
