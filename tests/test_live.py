"""Streams over several batches: drift monitor, delayed retries, sinks on other file systems."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions.special import ks_p
from quotemill.operators import quality as Q
from quotemill.session import scratch
from quotemill.sources import store
from quotemill.streaming import jobs, monitor
from quotemill.streaming.retry import RetryQueue

ROW = "symbol string, ts timestamp_ntz, tie long, price double, volume double"
START = pd.Timestamp("2024-01-01")


def land(spark, path, rows):
    """Append (symbol, second, price) rows to a landing folder."""
    data = [(s, (START + pd.Timedelta(seconds=at)).to_pydatetime(), n, p, 1.0) for n, (s, at, p) in enumerate(rows)]
    spark.createDataFrame(data, ROW).repartition(2).write.mode("append").parquet(path)


def watch(spark, batches, reference, rules, **named):
    """Alerts per batch as (symbol, rule, second)."""
    path = scratch(spark, "watch")
    ref = [(s, START.to_pydatetime(), n, p, 1.0) for n, (s, p) in enumerate(reference)]
    points = monitor.reference_points(spark.createDataFrame(ref, ROW), ["price"])
    stream, out = None, []
    for k, rows in enumerate(batches):
        land(spark, f"{path}/in", rows)
        stream = stream or monitor.drift_monitor(spark.readStream.schema(ROW).parquet(f"{path}/in"), points, ["price"], rules=rules, **named)
        jobs.start(stream, jobs.batch_writer(f"{path}/out"), f"{path}/checkpoint", "update").awaitTermination()
        done = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
        out = [(r.symbol, r.rule, int((r.ts - START.to_pydatetime()).total_seconds()), r.statistic, r.p_value, r.samples) for r in done.collect()]
    return sorted(out)


def test_monitor_equals_replay(spark):
    """Buffer, minimum, rules and cooldown, recomputed batch by batch; one key holds most rows."""
    rng = np.random.default_rng(1)
    reference = [("a", float(v)) for v in rng.normal(0, 1, 200)] + [("b", float(v)) for v in rng.normal(0, 1, 50)]
    batches = [[("a", 100 * k + i, float(v)) for i, v in enumerate(rng.normal(shift, 1, 90))] + [("b", 100 * k + i, float(v)) for i, v in enumerate(rng.normal(0, 1, 7))]
               + [("no reference", 100 * k, 1.0)] for k, shift in enumerate([0, 2, 2, 2, 0])]
    rules = [monitor.AlertRule("sure", "critical", max_p=0.01, cooldown=150.0), monitor.AlertRule("far", min_statistic=0.6, cooldown=0.0)]
    got = watch(spark, batches, reference, rules, window=60, min_samples=30)
    want, buffers, fired = [], {}, {}
    for rows in batches:
        for s in ("a", "b"):
            buffers[s] = (buffers.get(s, []) + sorted((at, p) for x, at, p in rows if x == s))[-60:]
            ref = np.sort([p for x, p in reference if x == s])
            mine = np.sort([p for _, p in buffers[s]])
            if len(mine) < 30:
                continue
            d = float(np.abs(np.searchsorted(mine, ref, "right") / len(mine) - np.searchsorted(ref, ref, "right") / len(ref)).max())
            p, now = ks_p(d, len(ref), len(mine)), buffers[s][-1][0]
            for rule in rules:
                if p < 0.05 and rule.met(d, p) and now - fired.get((s, rule.name), -1e9) >= rule.cooldown:
                    fired[s, rule.name] = now
                    want.append((s, rule.name, now, d, p, len(mine)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and len(want) >= 4
    assert np.allclose([g[3:] for g in got], [w[3:] for w in sorted(want)])
    sure = [g[2] for g in got if g[1] == "sure"]
    assert len(sure) >= 2 and all(b - a >= 150 for a, b in zip(sure, sure[1:]))


def test_monitor_thins_records_before_they_become_rows_per_feature(monkeypatch):
    """As Arrow columns, over several chunks: the newest numbers of every key and feature, with missing, undefined and infinite values."""
    import pyarrow as pa

    monkeypatch.setattr(monitor, "TASK_ROWS", 500)
    rng = np.random.default_rng(2)
    n = 2000
    pdf = pd.DataFrame({"symbol": rng.choice(["a", "b", "c"], n, p=[0.8, 0.19, 0.01]), "at_us": rng.integers(0, 400, n), "tie": rng.permutation(n)})
    pdf["at"] = pd.to_datetime(pdf["at_us"], unit="us", utc=True)
    pdf["_f0"], pdf["_f1"] = rng.normal(0, 1, n), rng.choice([1.0, np.inf, 2.0], n)
    kind = pa.schema([("symbol", pa.string()), ("at", pa.timestamp("us", "UTC")), ("at_us", pa.int64()), ("tie", pa.int64()), ("_f0", pa.float64()), ("_f1", pa.float64())])
    odd = rng.random(n)
    columns = {c: pdf[c].tolist() for c in kind.names}
    columns["_f0"] = [None if o < 0.2 else float("nan") if o < 0.4 else v for o, v in zip(odd, columns["_f0"])]
    batches = pa.table(columns, schema=kind).to_batches(max_chunksize=150)
    out = list(monitor._thinned(20, ["price", "volume"])(iter(batches)))
    got = pa.Table.from_batches(out).to_pandas()
    assert pa.Table.from_batches(out).schema.names == ["symbol", "feature", "at", "at_us", "tie", "value"]
    long = pd.concat([pdf.assign(feature="price", value=pdf["_f0"])[odd >= 0.4], pdf.assign(feature="volume", value=pdf["_f1"])])
    want = long.sort_values(["at_us", "tie"]).groupby(["symbol", "feature"]).tail(20)
    row = lambda d: sorted(d[["symbol", "feature", "at_us", "tie", "value"]].itertuples(index=False, name=None))
    assert row(got) == row(want) and (got["at"] == pd.to_datetime(got["at_us"], unit="us", utc=True)).all()
    assert list(monitor._thinned(20, ["price"])(iter([]))) == []


def test_monitor_state_is_bounded_and_rows_are_thinned_before_the_shuffle():
    rows = pd.DataFrame({"symbol": ["a"] * 500 + ["b"] * 3, "feature": "price", "at": START, "at_us": range(503), "tie": 0, "value": 1.0})
    kept = pd.concat(monitor._newest(20)(iter([rows.iloc[:300], rows.iloc[300:]])))
    assert kept.groupby("symbol").size().to_dict() == {"a": 20, "b": 3} and kept[kept.symbol == "a"].at_us.min() == 480


def test_reference_points(spark):
    data = [("a", START.to_pydatetime(), n, float(v), None) for n, v in enumerate([1, 1, 2, 3, 3, 3, 4, 5, 6, 7])] + [("a", START.to_pydatetime(), 99, None, None)]
    whole = monitor.reference_points(spark.createDataFrame(data, ROW), ["price", "volume"]).orderBy("value").collect()
    assert [(r.value, r.share) for r in whole] == [(1, 0.2), (2, 0.3), (3, 0.6), (4, 0.7), (5, 0.8), (6, 0.9), (7, 1.0)] and {r["size"] for r in whole} == {10}
    few = monitor.reference_points(spark.createDataFrame(data, ROW), ["price"], 2).orderBy("value").collect()
    assert [(r.value, r.share) for r in few] == [(3, 0.6), (7, 1.0)]


def test_retry_waits_heals_and_archives(spark):
    path, begin = scratch(spark, "retry-test"), datetime(2024, 5, 1)
    checks = [Q.in_range("price", 10, 90)]
    heal = lambda d: d.withColumn("price", F.when((F.col("symbol") == "late") & (F.col("attempts") == 2), 50.0).otherwise(F.col("price")))
    queue = RetryQueue(spark, path, checks, heal, max_attempts=3, delay=60)
    queue.retry(begin)  # nothing there yet
    land(spark, f"{path}/in", [("fine", 0, 20.0), ("late", 1, 95.0), ("never", 2, 95.0), ("never", 3, 5.0)])
    live = spark.readStream.schema(ROW).parquet(f"{path}/in")
    jobs.start(live, queue.sink(begin), f"{path}/checkpoint").awaitTermination()
    for seconds in (59, 60, 119, 120):
        queue.retry(begin + timedelta(seconds=seconds))
    land(spark, f"{path}/in", [("late", 9, 95.0)])  # joins the queue later, so its attempts lie later too
    jobs.start(live, queue.sink(begin + timedelta(seconds=130)), f"{path}/checkpoint").awaitTermination()
    for seconds in (180, 190, 250, 400):
        queue.retry(begin + timedelta(seconds=seconds))
    good = sorted((r.symbol, r.attempts, r.by) for r in queue.read("good").collect())
    assert good == [("fine", 0, "live"), ("late", 2, "retry"), ("late", 2, "retry")]
    gone = [(r.symbol, r.attempts, r.issues[0].field, r.archived_at) for r in queue.read("archive").collect()]
    assert gone == [("never", 3, "price", begin + timedelta(seconds=180))] * 2
    assert queue.counts().first().asDict() == {"retried": 3 + 3 + 2 + 1 + 1, "recovered": 2, "archived": 2}


def test_a_replayed_batch_counts_once(spark):
    path, begin = scratch(spark, "replay"), datetime(2024, 5, 1)
    queue = RetryQueue(spark, path, [Q.in_range("price", 10, 90)], delay=0)
    df = spark.createDataFrame([("a", START.to_pydatetime(), 1, 95.0, 1.0), ("b", START.to_pydatetime(), 2, 20.0, 1.0)], ROW)
    write = queue.sink(begin)
    for _ in range(2):  # the second run has another clock, but the batch keeps its time
        write(df, 0)
        write = queue.sink(begin + timedelta(hours=1))
    assert queue.read("good").count() == 1
    queued = spark.read.parquet(f"{path}/queue").collect()
    assert [(r.symbol, r.failed_at, r.next_attempt) for r in queued] == [("a", begin, begin)]
    queue.retry(begin)
    assert queue.counts().first().retried == 1


@pytest.fixture
def other_files(spark, tmp_path):
    """A file system besides the default one."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./table", f"file://{tmp_path}")
    return "viewfs://other/table"


def test_delete_on_another_file_system(spark, other_files):
    path = f"{other_files}/t"
    spark.range(10).selectExpr("id", "CASE WHEN id < 3 THEN 'x y/%41' ELSE 'y' END AS part").write.partitionBy("part").parquet(path)
    assert store.delete_where(spark, path, F.col("id") < 4) == 4
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(4, 10))


def test_upsert_without_success_marker(spark, other_files):
    path = f"{other_files}/u"
    handler = jobs.upsert_handler(path, ["id"], ["v"], "part")
    key = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    spark.conf.set(key, "false")
    try:
        for batch, rows in enumerate([[(1, "a", 1.0), (2, "b", 2.0)], [(2, "b", 3.0), (3, "a", 4.0)]]):
            handler(spark.createDataFrame(rows, "id int, part string, v double"), batch)
    finally:
        spark.conf.unset(key)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]


def test_streams_take_in_one_batch_per_part(spark, tables):
    """Parts land as Spark writes them, in several files, and still make one batch each."""
    from quotemill.plans.stream_queries import BATCHES, Arrivals

    events = tables.events.repartition(3)
    a = Arrivals(tables, parts=[events.filter(cond) for cond in BATCHES])
    out = a.table(a.stream(), "parts")
    got = {r.batch: (r.n, r.first, r.last) for r in out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}
    assert len(got) == 4 and sum(n for n, _, _ in got.values()) == tables.events.count()
    assert all(got[k][2] < got[k + 1][1] for k in range(3))
