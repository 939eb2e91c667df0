"""Total losses, gaps, empty samples, replays and versions: the cases plain data does not hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import drift as D
from quotemill.operators import governance as G
from quotemill.operators import indicators as I
from quotemill.operators import joins as J
from quotemill.operators import quality as Q
from quotemill.operators import risk as K
from quotemill.operators import rolling as X
from quotemill.operators.feature_store import FeatureStore
from quotemill.operators.ordered import Panel, Series, memory_rows
from quotemill.session import materialize, path_exists, release, scratch
from quotemill.sources import kafka, store
from quotemill.streaming import jobs

S = Series(keys=("symbol",), ts="ts", tie=(), slices=4)


def series(spark, values, name="close", symbol="a"):
    ts = pd.date_range("2024-01-01", periods=len(values), freq="h")
    rows = [(symbol, t.to_pydatetime(), None if v is None else float(v)) for t, v in zip(ts, values)]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp_ntz, {name} double")


@pytest.mark.parametrize("block", [2, 16384])
def test_total_loss_ends_an_equity_curve(spark, block):
    df = series(spark, [0.1, -0.5, -1.0, 3.0, 0.2], "ret")
    got = X.equity_curve(df, S.with_(block_rows=block)).orderBy("ts").collect()
    assert [round(r.equity, 9) for r in got] == [1.1, 0.55, 0, 0, 0] and [round(r.drawdown, 9) for r in got] == [0, -0.5, -1, -1, -1]
    assert [r.periods_under for r in got] == [0, 1, 2, 3, 4] and {round(r.peak, 9) for r in got} == {1.1}
    perf = K.performance(df, S).first()
    assert perf.total_return == -1 and perf.annual_return == -1 and perf.max_drawdown == -1
    first = X.equity_curve(series(spark, [-1.5, 0.5], "ret"), S).orderBy("ts").collect()
    assert [(r.equity, r.peak, r.drawdown, r.periods_under) for r in first] == [(0, 1, -1, 1), (0, 1, -1, 2)]


def test_averages_over_gaps_are_weighted_by_position(spark):
    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.3 else float(v) for v in 100 + rng.normal(0, 1, 200).cumsum()]
    p = Panel(series(spark, x), S)
    for n in (3, 26):
        I.ema(p, n)
    got = p.done().orderBy("ts").toPandas()
    for n in (3, 26):
        alpha, num, den, want = 2 / (n + 1), 0.0, 0.0, []
        for i, v in enumerate(x):
            w = 0.0 if v is None else 1.0 if i == 0 else alpha
            num, den = num * (1 - alpha) + w * (v or 0.0), den * (1 - alpha) + w
            want.append(num / den if den else None)
        assert np.allclose(got[f"ema_{n}"].astype(float), np.array(want, dtype=float), equal_nan=True)


def test_a_gap_does_not_pull_an_average_down(spark):
    p = Panel(series(spark, [10, 10, None, 10, 10]), S)
    I.ema(p, 3)
    assert [round(r.ema_3, 9) for r in p.done().orderBy("ts").collect()] == [10] * 5


def test_fast_decay_and_span_one(spark):
    x = [float(i % 7) for i in range(400)]
    p = Panel(series(spark, x), S)
    p.ema("fast", "close", alpha=0.95)
    I.ema(p, 1)
    got = p.done().orderBy("ts").toPandas()
    assert np.allclose(got["fast"], pd.Series(x).ewm(alpha=0.95, adjust=False).mean()) and got["ema_1"].tolist() == x
    assert all(memory_rows(1 - a) * -np.log10(1 - a) < 300 for a in (0.5, 0.9, 0.95, 0.99, 0.999))


def test_oscillators_with_gaps_and_flat_prices(spark):
    df = series(spark, [10] * 40).withColumns({"high": F.col("close"), "low": F.col("close"), "open": F.col("close"), "volume": F.lit(1.0)})
    p = Panel(df, S)
    I.rsi(p, method="wilder")
    I.macd(p)
    I.atr(p, method="wilder") if "method" in I.atr.__code__.co_varnames else I.true_range(p)
    last = p.done().orderBy(F.desc("ts")).first()
    assert last.rsi_wilder_14 == 50 and abs(last.macd) < 1e-12
    gap = series(spark, [10, 11, None, 12, 13] * 10)
    p = Panel(gap, S)
    I.rsi(p, method="wilder")
    I.macd(p)
    got = p.done().toPandas()
    assert got["rsi_wilder_14"].dropna().between(0, 100).all() and got["macd"].notna().all()


def test_zero_prices_do_not_stop_running_totals(spark):
    df = series(spark, [1, 0, 2, 3]).withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "open": F.col("close"), "volume": F.lit(5.0)})
    assert I.running_totals_of_volume(df, S).count() == 4
    p = Panel(df, S)
    I.ewma_variance(p)
    assert p.done().count() == 4


def test_empty_samples_compare_as_null(spark):
    ref, none = series(spark, [1, 2, 3], "x"), series(spark, [], "x")
    for a, b in ((ref, none), (none, none)):
        for df in (D.order_statistics(a, b, ["x"]), D.binned_measures(D.shared_histogram(a, b, ["x"])), D.mean_tests(a, b, ["x"])):
            rows = df.collect()
            assert all(r[k] is None for r in rows for k in ("ks", "psi", "z") if k in df.columns)


def test_no_deviation_means_no_outlier(spark):
    df = series(spark, [5, 5, 9], "x")
    assert Q.validate(df, [Q.outlier("x", 5.0, 0.0)]).filter("size(issues) > 0").isEmpty()


def test_roles_are_exact(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS few", "concat('t', id) AS text", "CAST(NULL AS double) AS nothing")
    assert {r["column"]: r["role"] for r in D.infer_roles(df).collect()} == {"id": "numeric", "few": "categorical", "text": "categorical", "nothing": "numeric"}


def test_isolation_trees_draw_from_all_rows(spark):
    df = materialize(spark.range(5000).select(F.randn(1).alias("x"), F.randn(2).alias("y")), "normal")
    odd = spark.createDataFrame([(50.0, 50.0)], "x double, y double")
    scores = D.isolation_scores(df, df.unionByName(odd), ["x", "y"], trees=20, sample=64).toPandas()
    assert scores[scores.x == 50].anomaly_score.iloc[0] > scores.anomaly_score.quantile(0.99)
    assert D.isolation_scores(df.filter("false"), odd, ["x", "y"], trees=3).count() == 1


def test_checksum_sees_moved_nulls_names_and_types(spark):
    def of(sql):
        return G.table_checksum(spark.sql(sql)).first().checksum

    base = of("SELECT CAST(NULL AS int) AS a, 5 AS b")
    assert base != of("SELECT 5 AS a, CAST(NULL AS int) AS b")
    assert base != of("SELECT CAST(NULL AS int) AS a, 5 AS c") and base != of("SELECT CAST(NULL AS int) AS a, 5L AS b")
    assert base == of("SELECT 5 AS b, CAST(NULL AS int) AS a")


def test_lineage_has_no_silent_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "src string, dst string")
    start = spark.createDataFrame([("0",)], "node string")
    assert G.reachable(edges, start).agg(F.max("depth")).first()[0] == 60


VALUE = "feature string, version int, entity_id string, ts timestamp_ntz, value double"


def test_versions_promotions_and_late_deletion(spark):
    fs = FeatureStore(spark, scratch(spark, "fs"))
    for v in (1, 2, 3):
        fs.register("f", v)
    fs.promote("f", 1)
    fs.promote("f", 2)
    at = pd.Timestamp("2024-01-01")
    fs.write(spark.createDataFrame([("f", v, "e", at.to_pydatetime(), float(v)) for v in (1, 2, 3)], VALUE))
    ask = spark.createDataFrame([(1, "e", at.to_pydatetime())], "request_id long, entity_id string, ts timestamp_ntz")
    assert fs.lookup(ask, ["f"], production=True).first()["f"] == 2 and fs.lookup(ask, ["f"]).first()["f"] == 3
    assert fs.delete("f", 2) == 1 and fs.resolve(True).first()["version"] == 1
    assert sorted(r.version for r in fs.read(["f"]).collect()) == [1, 3] and fs.delete("f") == 2 and fs.read(["f"]).isEmpty()


def test_a_replayed_batch_counts_once(spark):
    root = scratch(spark, "sink")
    write = jobs.feature_handler(root, "f", 1, "symbol", "x")
    df = series(spark, [1, 2, 3], "x")
    for batch in (0, 1, 1):
        write(df, batch)
    assert FeatureStore(spark, root).read(["f"]).count() == 6


def landed(spark, parts=4):
    path = scratch(spark, "land")
    df = series(spark, range(40), "x").withColumn("n", F.expr("CAST(x AS int)"))
    for k in range(parts):
        df.filter(F.floor(F.col("n") / (40 / parts)) == k).drop("n").coalesce(1).write.parquet(f"{path}/in/{k}")
    return path, store.stream_table(spark, f"{path}/in/*", df.drop("n").schema, files_per_trigger=1)


def test_streams_run_file_by_file_and_metrics_keep_every_batch(spark):
    path, s = landed(spark)
    jobs.start(s, jobs.with_metrics(jobs.batch_writer(f"{path}/data"), f"{path}/metrics"), f"{path}/cp").awaitTermination()
    m = spark.read.parquet(f"{path}/metrics").orderBy("batch").collect()
    assert [(r.batch, r.input_rows) for r in m] == [(k, 10) for k in range(4)] and spark.read.parquet(f"{path}/data").count() == 40


def test_append_sink_writes_what_is_there(spark):
    path, s = landed(spark)
    jobs.append_sink(s, f"{path}/table", f"{path}/cp", every=None).awaitTermination()
    assert spark.read.parquet(f"{path}/table").count() == 40


def test_drift_columns_per_batch(spark):
    path, s = landed(spark)
    reference = series(spark, range(10), "x")
    jobs.start(s, jobs.drift_per_batch(f"{path}/drift", reference, ["x"]), f"{path}/cp").awaitTermination()
    got = spark.read.parquet(f"{path}/drift").orderBy("batch").collect()
    assert [r.drift for r in got] == [False, True, True, True] and got[0].p_value > 0.9 and got[3].ks == 1


def test_refresh_window_of_continuous_aggregates(spark):
    path = scratch(spark, "roll")
    rows = [("a", "v", f"2024-01-0{d} 10:00:00", d, float(d), 1.0) for d in (1, 2, 3)]
    ticks = spark.createDataFrame(rows, "symbol string, exchange string, at string, tie long, price double, volume double")
    ticks = ticks.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks", start="30 hours")(ticks, 0)
    assert sorted(str(r.bucket)[:10] for r in spark.read.parquet(f"{path}/bars").collect()) == ["2024-01-02", "2024-01-03"]


def test_buckets_outside_the_refresh_window_are_rebuilt_later(spark):
    def ticks(*rows):
        df = spark.createDataFrame([("a", "v", at, k, float(k), 1.0) for k, at in rows], "symbol string, exchange string, at string, tie long, price double, volume double")
        return df.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")

    def bars(path):
        out = jobs.latest(spark.read.parquet(path), ["symbol", "exchange", "bucket"])
        return {str(r.bucket)[5:16]: (r.open, r.close, r.trade_count) for r in out.collect()}

    path = scratch(spark, "pending")
    run = jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks", part="hour", end="1 hour")
    batches = [ticks((1, "2024-01-01 10:05:00"), (2, "2024-01-01 10:50:00")), ticks((3, "2024-01-01 11:30:00"), (4, "2024-01-01 10:55:00")), ticks((5, "2024-01-01 13:00:00"))]
    for k, batch in enumerate(batches):
        run(batch, k)
        run(batch, k)  # a replayed batch changes nothing
    assert bars(f"{path}/bars") == {"01-01 10:00": (1.0, 4.0, 3), "01-01 11:00": (3.0, 3.0, 1)}
    jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks", part="hour")(ticks((6, "2024-01-01 14:00:00")), 3)
    assert bars(f"{path}/bars")["01-01 13:00"] == (5.0, 5.0, 1) and len(bars(f"{path}/bars")) == 4

    path = scratch(spark, "late")
    run = jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks", start="30 hours")
    for k, batch in enumerate([ticks((1, "2024-01-03 10:00:00")), ticks((2, "2024-01-01 10:00:00"), (3, "2024-01-03 11:00:00"))]):
        run(batch, k)
    assert sorted(bars(f"{path}/bars")) == ["01-03 10:00", "01-03 11:00"]
    jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks")(ticks((4, "2024-01-03 12:00:00")), 2)
    assert bars(f"{path}/bars")["01-01 10:00"] == (2.0, 2.0, 1)

    path = scratch(spark, "wide")  # a bucket that lies in several folders
    run = jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks", "1d", part="hour")
    for k, batch in enumerate([ticks((1, "2024-01-01 10:00:00")), ticks((2, "2024-01-01 11:00:00"))]):
        run(batch, k)
    assert bars(f"{path}/bars") == {"01-01 00:00": (1.0, 2.0, 2)}


def test_hot_partitions_are_written_by_several_tasks(spark):
    path = scratch(spark, "hot")
    spark.createDataFrame([(-1, "hot", "x"), (-2, "cold", "x")], "id long, part string, v string").write.partitionBy("part").parquet(path)
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        new = spark.range(40_000).selectExpr("id", "IF(id % 100 = 0, 'cold', 'hot') AS part", "sha2(CAST(id AS string), 256) AS v")
        store.upsert(spark, path, new, ["id"], ["v"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    df = spark.read.parquet(path)
    files = df.filter("part = 'hot'").select(F.col("_metadata.file_path")).distinct().count()
    assert files > 1 and df.count() == 40_002


def test_deletion_removes_emptied_folders(spark):
    path = scratch(spark, "del")
    spark.range(20).selectExpr("id", "IF(id < 5, 'a b', 'y') AS part").write.partitionBy("part").parquet(path)
    assert store.delete_where(spark, path, F.col("id") < 7) == 7
    assert not path_exists(spark, f"{path}/part=a b") and spark.read.parquet(path).count() == 13


def test_archive_can_be_repeated(spark):
    path, old = scratch(spark, "table"), scratch(spark, "old")
    spark.range(10).selectExpr("id", "'p' AS part").write.partitionBy("part").parquet(path)
    spark.range(4).selectExpr("id", "'p' AS part").write.partitionBy("part").parquet(f"{old}/run=r1")  # a run that failed before deleting
    assert G.archive(spark, path, old, F.col("id") < 4, run="r1") == 4
    assert spark.read.parquet(old).count() == 4 and spark.read.parquet(path).count() == 6


def test_standing_quotes_cross_even_if_the_extremes_share_a_venue(spark):
    rows = [(0, "A", 99.0, 101.0), (1, "B", 95.0, 98.0), (2, "A", 120.0, 90.0)]
    q = spark.createDataFrame([("s", pd.Timestamp(f"2024-01-01 00:00:0{i}").to_pydatetime(), i, v, b, a, 1.0, 2.0) for i, v, b, a in rows],
                              "symbol string, ts timestamp_ntz, tie long, exchange string, bid double, ask double, bid_size double, ask_size double")
    series_ = Series(keys=("symbol",), ts="ts", tie=("tie",), slices=2)
    got = {r.tie: (r.buy_exchange, r.sell_exchange, r.buy_price, r.sell_price, r.gap_ms) for r in J.venue_match(q, series_, ["A", "B"], 60_000).collect()}
    assert got[1] == ("B", "A", 98.0, 99.0, 1000.0) and 2 not in got  # at 2 both extremes sit on A
    assert J.venue_match(q, series_, ["A", "B"], 500).isEmpty()


def test_broker_options_fail_on_data_loss_unless_told():
    assert kafka.source_options("h:1", "t")["failOnDataLoss"] == "true"
    assert kafka.source_options("h:1", "t", fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_release_removes_intermediates(spark):
    materialize(spark.range(3), "gone")
    path = scratch(spark, "kept")
    spark.range(2).write.parquet(path)
    assert path_exists(spark, path) and release(spark) >= 2 and not path_exists(spark, path)


def test_tail_weights_have_the_best_mean_of_the_worst_returns(spark):
    from quotemill.operators import portfolio as P

    rng = np.random.default_rng(5)
    crash = np.where(rng.random(600) < 0.08, -0.3, 0.02)  # a good mean with a bad tail, beside a dull asset
    pdf = pd.DataFrame({"x": crash, "y": rng.normal(0.001, 0.01, 600)})
    w = {r.asset: r.weight for r in P.optimal_weights(spark, spark.createDataFrame(pdf), ["x", "y"], "cvar").collect()}
    assert w["y"] > 0.95

    def tail(a, b):
        r = np.sort(a * pdf["x"] + b * pdf["y"])
        return r[: len(r) // 20].mean()

    assert tail(w["x"], w["y"]) >= max(tail(a, 1 - a) for a in (0.1, 0.3, 0.5))


def test_draws_do_not_depend_on_the_layout(spark):
    df = series(spark, [0.01, -0.02, 0.03, 0.0], "ret").withColumnRenamed("symbol", "asset")
    assert K.monte_carlo_var(df, draws=500).first() == K.monte_carlo_var(df.repartition(3), draws=500).first()
