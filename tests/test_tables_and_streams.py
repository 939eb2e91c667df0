import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import governance as G
from quotemill.operators import portfolio as PF
from quotemill.operators import risk as K
from quotemill.operators.feature_store import FeatureStore
from quotemill.operators.ordered import Series
from quotemill.session import scratch
from quotemill.sources import decode, kafka, store
from quotemill.streaming import jobs

TICKS = "symbol string, ts timestamp_ntz, tie long, price double, volume double"


def ticks(spark, rows):
    pdf = pd.DataFrame(rows, columns=["symbol", "minute", "tie", "price", "volume"])
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.pop("minute"), "min")
    return spark.createDataFrame(pdf[["symbol", "ts", "tie", "price", "volume"]], TICKS)


def test_upsert_keeps_the_last_write_and_untouched_partitions(spark):
    path = scratch(spark, "t")
    base = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "id int, part string, v double")
    base.write.partitionBy("part").parquet(path)
    new = spark.createDataFrame([(2, "a", 20.0), (2, "a", 30.0), (4, "a", 4.0)], "id int, part string, v double")
    store.upsert(spark, path, new.select(base.columns), ["id"], ["v"])
    got = {r["id"]: r["v"] for r in spark.read.schema(base.schema).parquet(path).collect()}
    assert got == {1: 1.0, 2: 30.0, 3: 3.0, 4: 4.0}


def test_delete_empties_a_partition(spark):
    path = scratch(spark, "t")
    spark.range(10).selectExpr("id", "IF(id < 3, 'x', 'y') AS part").write.partitionBy("part").parquet(path)
    assert store.delete_where(spark, path, F.col("id") < 4) == 4
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(4, 10))


def test_layouts_and_formats(spark):
    assert store.format_of("/x/y.jsonl") == "json"
    with pytest.raises(ValueError):
        store.format_of("/x/y.h5")
    d = ticks(spark, [("a", 61, 1, 1.0, 1.0)]).select(store.layout("composite", unit="hour").alias("k"), store.layout("time", unit="week").alias("w"))
    assert d.first().asDict() == {"k": "2024-01-01-01|a", "w": "2024-W01"}


def test_broker_options():
    o = kafka.source_options("h:9092", ["a", "b"], "earliest", True, 100)
    assert o["subscribe"] == "a,b" and o["startingOffsets"] == "earliest" and o["includeHeaders"] == "true" and o["maxOffsetsPerTrigger"] == "100"
    assert kafka.sink_options("h:9092", "t", "/c") == {"kafka.bootstrap.servers": "h:9092", "topic": "t", "checkpointLocation": "/c"}


def test_raw_decoding(spark):
    d = spark.createDataFrame([(bytearray(b'{"a":1}'),), (bytearray(b"plain"),), (bytearray(b"\xff\xfe"),)], "p binary")
    assert [r[0] for r in d.select(decode.decode_raw("p")).collect()] == ['{"a":1}', '{"raw":"plain"}', '{"raw":"fffe"}']


@pytest.mark.parametrize("block", [2, 16384])
def test_position_buy_buy_sell_close(spark, block):
    rows = [("buy", 10.0, 100.0), ("buy", 10.0, 110.0), ("sell", 5.0, 120.0), ("sell", 15.0, 100.0), ("sell", 1.0, 90.0), ("buy", 2.0, 50.0)]
    pdf = pd.DataFrame([("a", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), k, *r) for k, r in enumerate(rows)], columns=["symbol", "ts", "tie", "side", "quantity", "price"])
    t = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, tie long, side string, quantity double, price double")
    got = PF.positions(t, Series(slices=3, block_rows=block)).orderBy("tie").toPandas()
    assert got["held"].tolist() == [10, 20, 15, 0, 0, 2]
    assert got["entry_price"].tolist() == pytest.approx([100, 105, 105, 0, 0, 50])
    assert got["realized_pnl"].tolist() == pytest.approx([0, 0, 75, 0, 0, 0])
    assert got["unrealized_pnl"].tolist() == pytest.approx([0, 100, 225, 0, 0, 0])
    assert got["oversold"].tolist() == [False, False, False, False, True, False]


def test_risk_order(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    d = spark.createDataFrame(pd.DataFrame({"asset": "x", "ts": pd.date_range("2020-01-01", periods=1000), "ret": rng.normal(0, 0.02, 1000)}), "asset string, ts timestamp_ntz, ret double")
    v95, v99 = (K.historical_var(d, confidence=q).first()["var"] for q in (0.95, 0.99))
    g95 = K.gaussian_var(d).first()["var"]
    t95 = K.student_var(d).first()["var"]
    c5 = K.expected_shortfall(d).first()["cvar_5"]
    mc = K.monte_carlo_var(d).first()["var"]
    assert v99 < v95 < 0 and c5 < v95 and -0.04 < g95 < -0.025
    assert t95 == pytest.approx(g95, rel=0.01) and mc == pytest.approx(g95, rel=0.08)
    perf = K.performance(d, Series(keys=("asset",), ts="ts", tie=(), slices=4, block_rows=64)).first()
    r = d.toPandas()["ret"]
    eq = (1 + r).cumprod()
    assert perf["max_drawdown"] == pytest.approx((eq / eq.cummax() - 1).min())
    assert perf["skew"] == pytest.approx(r.skew()) and perf["kurtosis"] == pytest.approx(r.kurt())


def test_lineage_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in G.reachable(e, start).collect()} == {("b", 1), ("c", 1)}
    assert {(r["node"], r["depth"]) for r in G.reachable(e, start, backwards=True).collect()} == {("c", 1), ("b", 2)}


def test_feature_lookup_has_no_future(spark):
    fs = FeatureStore(spark, scratch(spark, "fs"))
    fs.register("f", 1)
    fs.promote("f", 1)
    v = pd.DataFrame([("f", 1, "e", pd.Timestamp("2024-01-01"), 1.0), ("f", 1, "e", pd.Timestamp("2024-01-03"), 3.0)], columns=["feature", "version", "entity_id", "ts", "value"])
    fs.write(spark.createDataFrame(v, "feature string, version int, entity_id string, ts timestamp_ntz, value double"))
    r = pd.DataFrame([(1, "e", pd.Timestamp("2023-12-31")), (2, "e", pd.Timestamp("2024-01-02")), (3, "e", pd.Timestamp("2024-01-03"))], columns=["request_id", "entity_id", "ts"])
    got = fs.lookup(spark.createDataFrame(r, "request_id long, entity_id string, ts timestamp_ntz"), ["f"])
    assert {x["request_id"]: x["f"] for x in got.collect()} == {1: None, 2: 1.0, 3: 3.0}
    assert fs.resolve(True).first()["version"] == 1
    fs.delete("f")
    assert fs.metadata().isEmpty() and fs.read(["f"]).isEmpty()


def _land(spark, path, k, rows):
    ticks(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in/{k}")


def test_append_windows_drop_late_rows_and_survive_a_restart(spark):
    """Two runs on one checkpoint; a row behind the watermark is ignored, a row within it counts."""
    path = scratch(spark, "s")
    schema = ticks(spark, [("a", 0, 0, 1.0, 1.0)]).schema
    batches = [[("a", 1, 1, 10.0, 1.0), ("a", 30, 2, 20.0, 1.0)], [("a", 27, 3, 30.0, 1.0), ("a", 2, 4, 99.0, 1.0)], [("a", 90, 5, 1.0, 1.0)], [("a", 200, 6, 1.0, 1.0)]]
    for k, rows in enumerate(batches):
        _land(spark, path, k, rows)
        s = store.stream_table(spark, f"{path}/in/*", schema)
        jobs.start(jobs.tumbling(s, "5 minutes"), jobs.batch_writer(f"{path}/out"), f"{path}/cp").awaitTermination()
    out = spark.read.parquet(f"{path}/out").orderBy("window_start").toPandas()
    got = {str(r.window_start)[11:16]: (r.tick_count, r.max_price) for r in out.itertuples()}
    assert got == {"00:00": (1, 10.0), "00:25": (1, 30.0), "00:30": (1, 20.0), "01:30": (1, 1.0)}


def test_dead_letters_are_archived_after_three_attempts(spark):
    from quotemill.operators import quality as Q

    checks = [Q.in_range("price", 0, 10)]
    dead = Q.validate(ticks(spark, [("a", 0, 1, 99.0, 1.0), ("a", 1, 2, 11.0, 1.0)]), checks).drop("valid").withColumn("attempts", F.lit(0))
    fix = lambda d: d.withColumn("price", F.when(F.col("price") < 20, F.lit(9.0)).otherwise(F.col("price")))
    good, dead, archived = jobs.retry_dead_letters(dead, fix, checks)
    assert (good.count(), dead.count(), archived.count()) == (1, 1, 0)
    for _ in range(2):
        good, dead, archived = jobs.retry_dead_letters(dead, fix, checks)
    assert (good.count(), dead.count(), archived.count()) == (0, 0, 1)
