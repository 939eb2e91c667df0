"""Structured Streaming jobs: sources, windows, joins, sinks.

Results go to a folder with one sub-folder per micro-batch.  A replayed batch overwrites its own folder, so
each batch counts once, and ``latest`` reads the newest version of every row that update mode emitted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotemill.operators.bars import tick_summary
from quotemill.operators.ordered import attach
from quotemill.schemas import INTERVALS
from quotemill.session import has_data, path_exists, scratch
from quotemill.sources.store import latest_per_key

c = F.col
Batch = Callable[[DataFrame, int], None]


def batch_writer(path: str) -> Batch:
    """Idempotent sink: batch n always replaces ``batch=n``."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def start(df: DataFrame, handler: Batch, checkpoint: str, mode: str = "append", every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Run ``handler`` per micro-batch; without a trigger interval the available data is processed and the query ends."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handler)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return (w.queryName(name) if name else w).start()


def run_to_table(df: DataFrame, label: str, mode: str = "append", handler: Callable[[str], Batch] = batch_writer) -> DataFrame:
    """Process what is available into a new folder of the shared storage and read it back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    start(df, handler(f"{path}/data"), f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last emitted version of each row."""
    return latest_per_key(table, list(keys), ["batch"]).drop("batch")


def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", every: str | None = "60 seconds") -> StreamingQuery:
    """Plain append to a table format; without an interval the available data is processed and the query ends."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def held(handler: Batch) -> Batch:
    """A handler that reads its batch several times gets it computed once, and releases it after."""
    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            handler(df, batch)
        finally:
            df.unpersist()

    return write


# -- windows ---------------------------------------------------------------------------------------------


def watermarked(df: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """Event time must be an instant; plain timestamps are taken as UTC (the session time zone)."""
    return df.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, late)


def plain_times(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({x: c(x).cast("timestamp_ntz") for x in cols})


def tumbling(ticks: DataFrame, size: str, late: str = "5 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return plain_times(tick_summary(watermarked(ticks, late), F.window("ts", size), keys), "window_start", "window_end")


def sliding(ticks: DataFrame, size: str, slide: str, late: str = "5 minutes", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return plain_times(tick_summary(watermarked(ticks, late), F.window("ts", size, slide), keys), "window_start", "window_end")


def sessions(ticks: DataFrame, gap: str, late: str = "5 minutes", keys: Sequence[str] = ("user_id",)) -> DataFrame:
    s = F.session_window("ts", gap)
    out = watermarked(ticks, late).groupBy(s.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return plain_times(out.select(*keys, c("w.start").alias("start_ts"), c("w.end").alias("end_ts"), "n", "total"), "start_ts", "end_ts")


def windowed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], within: str, late: str = "5 minutes", how: str = "inner") -> DataFrame:
    """Equi join of two streams with the right row at most ``within`` before the left one; state expires with the watermark.

    Sides need distinct column names apart from the keys; times are ``l_ts`` and ``r_ts``.
    """
    a, b = watermarked(left, late, "l_ts"), watermarked(right, late, "r_ts")
    for k in keys:
        b = b.withColumnRenamed(k, f"_r_{k}")
    on = (c("r_ts") <= c("l_ts")) & (c("r_ts") >= c("l_ts") - F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (c(k) == c(f"_r_{k}"))
    return a.join(b, on, how).drop(*[f"_r_{k}" for k in keys])


def deduplicated(df: DataFrame, keys: Sequence[str], late: str = "5 minutes", ts: str = "ts") -> DataFrame:
    return plain_times(watermarked(df, late, ts).dropDuplicatesWithinWatermark(list(keys)), ts)


# -- per-batch handlers ----------------------------------------------------------------------------------


def with_late_rows(path: str, late_seconds: float, ts: str = "ts") -> Batch:
    """Split each batch by the newest time of the batches before it: on-time rows and a table of late rows.

    The newest time per batch is a one-row file; rows older than it minus the allowance are late.
    """
    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        top = None
        if batch > 0:
            top = spark.read.parquet(f"{path}/newest/batch={batch - 1}").first()[0]
        limit = F.lit(top).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(float(late_seconds)))
        is_late = F.lit(False) if top is None else c(ts) < limit
        df = df.withColumn("is_late", is_late)
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        # The file holds the newest time so far, so the next batch reads one row whatever came before.
        newest = df.agg(F.max(ts).alias("top"))
        if top is not None:
            newest = newest.select(F.greatest("top", F.lit(top).cast("timestamp_ntz")).alias("top"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")

    return held(write)


def incremental_rollup(path: str, source: str, interval: str = "1h", part: str = "day", start: str | None = None, end: str | None = None) -> Batch:
    """Continuous aggregate: store ticks by time, rebuild only the coarse buckets the batch touches.

    Ticks lie in folders by ``part`` and batch, and only the folders of touched buckets are read again.  The refresh
    window takes buckets from ``start`` to ``end`` before the newest time of the batch; the keys of others are kept in
    ``_pending`` below ``path`` by batch and rebuilt by the first later batch whose window holds them (one without a
    window takes all).
    """
    from quotemill.operators.bars import bucket, ohlcv, rollup_bars

    length = INTERVALS[interval]
    span = F.expr(f"INTERVAL 1 {length}" if length in ("week", "month") else f"INTERVAL {length}")

    def part_of(at: Column) -> Column:
        return F.date_trunc(part, at).cast("timestamp_ntz").cast("string")

    def write(ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        rows = ticks.select("symbol", "exchange", "ts", "tie", "price", "volume", part_of(c("ts")).alias("slot"))
        rows = rows.withColumn("batch", F.lit(batch)).hint("rebalance", "slot")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(source)
        touched = ticks.select("symbol", "exchange", bucket("ts", interval).alias("bucket")).distinct()
        before, now = f"{path}/_pending/batch={batch - 1}", f"{path}/_pending/batch={batch}"
        if path_exists(spark, before):
            touched = touched.unionByName(spark.read.parquet(before)).distinct()
        if start or end:
            inside = F.lit(True)
            if start:
                inside = inside & (c("bucket") >= c("top") - F.expr(f"INTERVAL {start}"))
            if end:
                inside = inside & (c("bucket") <= c("top") - F.expr(f"INTERVAL {end}"))
            marked = attach(touched, ticks.agg(F.max("ts").alias("top"))).withColumn("inside", F.coalesce(inside, F.lit(False)))
            marked.filter(~c("inside")).drop("top", "inside").write.mode("overwrite").parquet(now)
            touched = marked.filter("inside").drop("top", "inside")
        # Folders of the buckets to rebuild: the first and the last one of each bucket, mostly the same.
        ends = touched.select(part_of(c("bucket")), part_of(c("bucket") + span - F.expr("INTERVAL 1 MICROSECOND"))).distinct().collect()
        slot = c("slot").cast("string")
        near = slot.isin([a for a, b in ends if a == b])
        for a, b in ends:
            near = near if a == b else near | slot.between(a, b)
        stored = spark.read.parquet(source).filter(near & (c("batch") <= batch))
        affected = stored.withColumn("bucket", bucket("ts", interval)).join(touched, ["symbol", "exchange", "bucket"], "left_semi").drop("bucket", "batch", "slot")
        rollup_bars(ohlcv(affected, "1m"), interval).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return held(write)


def drift_per_batch(path: str, reference: DataFrame, features: Sequence[str], alpha: float = 0.05) -> Batch:
    """Score (mean shift), KS with p-value, stability index and a flag per feature and batch, against a stored reference.

    The reference is read once, here; batches are compared with its counts and moments.
    """
    from quotemill.functions.special import ks_p, on_rows
    from quotemill.operators import drift as D

    reference = D.summarize_reference(reference, features)

    def write(df: DataFrame, batch: int) -> None:
        o = D.order_statistics(reference, df, features).select("feature", "ks", "n", "m")
        b = D.binned_measures(D.shared_histogram(reference, df, features)).select("feature", "psi")
        s = D.mean_tests(reference, df, features).select("feature", "mean_shift")
        out = o.join(b, "feature").join(s, "feature").withColumn("p_value", on_rows(ks_p, "ks", "n", "m"))
        out.withColumn("drift", c("p_value") < alpha).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return held(write)


def with_dead_letters(path: str, checks: Sequence[Column]) -> Batch:
    """Valid rows to ``good``; invalid rows to ``dead`` with their issues and an attempt counter."""
    from quotemill.operators.quality import validate

    def write(df: DataFrame, batch: int) -> None:
        v = validate(df, checks)
        v.filter("valid").drop("issues", "valid").write.mode("overwrite").parquet(f"{path}/good/batch={batch}")
        v.filter("NOT valid").drop("valid").withColumn("attempts", F.lit(0)).write.mode("overwrite").parquet(f"{path}/dead/batch={batch}")

    return held(write)


def retry_dead_letters(dead: DataFrame, fix: Callable[[DataFrame], DataFrame], checks: Sequence[Column], max_attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recovered, still dead, archived): repair and validate again; rows out of attempts are archived."""
    from quotemill.operators.quality import validate

    tried = validate(fix(dead.drop("issues")), checks).withColumn("attempts", c("attempts") + 1)
    good = tried.filter("valid").drop("issues", "valid", "attempts")
    bad = tried.filter("NOT valid").drop("valid")
    return good, bad.filter(c("attempts") < max_attempts), bad.filter(c("attempts") >= max_attempts)


def upsert_handler(path: str, keys: Sequence[str], order: Sequence[str], part: str) -> Batch:
    """Upsert sink by primary key on a partitioned table."""
    from quotemill.sources.store import upsert

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.drop("batch")
        if not has_data(spark, path):
            latest_per_key(df, keys, order).hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(path)
        else:
            upsert(spark, path, df, keys, order, part)

    return write


def feature_handler(root: str, feature: str, version: int, entity: str, value: str, ts: str = "ts") -> Batch:
    """Feature-store sink: each batch holds its values under its own number, so a replayed batch replaces itself."""
    from quotemill.operators.feature_store import FeatureStore

    def write(df: DataFrame, batch: int) -> None:
        rows = df.select(F.lit(feature).alias("feature"), F.lit(version).alias("version"), c(entity).cast("string").alias("entity_id"), c(ts).alias("ts"), c(value).cast("double").alias("value"))
        FeatureStore(df.sparkSession, root).write(rows, batch)

    return write


def with_alerts(path: str, rules: dict[str, tuple[Column, str]], keys: Sequence[str]) -> Batch:
    """Attach alerts to a stream: every row goes on with the names of the rules it meets, and each alert is a row of its own.

    ``rules`` maps a name to a condition and a severity; a condition that is null is not met.
    """
    met = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
                             for name, (when, severity) in rules.items()]), lambda x: x.isNotNull())

    def write(df: DataFrame, batch: int) -> None:
        marked = df.withColumn("_met", met)
        marked.withColumn("alerts", F.transform("_met", lambda x: x["rule"])).drop("_met").write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        marked.select(*keys, F.explode("_met").alias("a")).select(*keys, "a.*").write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")

    return held(write)


def with_metric_log(path: str, metrics: Callable[[DataFrame], DataFrame]) -> Batch:
    """Append the judged quality metrics of every batch to a table; a replayed batch replaces its own."""
    from quotemill.operators.quality import judged

    def write(df: DataFrame, batch: int) -> None:
        judged(metrics(df)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return held(write)


# -- metrics ---------------------------------------------------------------------------------------------

METRICS = "input_rows long, batch_ms long, rows_per_second double"


def with_metrics(handler: Batch, path: str) -> Batch:
    """Keep input rows, duration and rate of every batch in a table, one folder per batch.

    Rows are counted while ``handler`` reads the batch, which it must do at least once; a replayed batch replaces its row.
    """
    def write(df: DataFrame, batch: int) -> None:
        seen, began = Observation(), time.monotonic()
        handler(df.observe(seen, F.count(F.lit(1)).alias("rows")), batch)
        seconds, rows = time.monotonic() - began, seen.get["rows"]
        one = [(rows, int(seconds * 1000), rows / max(seconds, 1e-3))]
        df.sparkSession.createDataFrame(one, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
