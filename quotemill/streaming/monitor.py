"""Live drift monitor: a sliding buffer of samples per key and feature, tested after every batch, with rules and cooldowns.

What reaches a key's state is thinned before the shuffle: of one batch, every task hands on no more than the newest
``window`` samples of a key, because older ones could not stay in the buffer.  The state of a key and feature is that
buffer, the points of the reference's distribution (given once, as initial state) and the time each rule fired last;
an event-time timer forgets a firing when its cooldown has passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.functions.special import ks_p
from quotemill.operators.ordered import epoch_us, running_totals
from quotemill.session import materialize
from quotemill.streaming.stateful import use_rocksdb

TASK_ROWS = 200_000
SAMPLE = "symbol string, feature string, at timestamp, at_us long, tie long, value double"
ALERT = "symbol string, feature string, rule string, severity string, at_us long, statistic double, p_value double, samples long, message string"


@dataclass(frozen=True)
class AlertRule:
    """Fires for a drifted feature whose p-value is below ``max_p`` or whose statistic is above ``min_statistic``.

    The next firing is at least ``cooldown`` seconds of event time later.
    """

    name: str
    severity: str = "warning"
    max_p: float | None = None
    min_statistic: float | None = None
    cooldown: float = 300.0
    message: str = "Drift in {feature} of {symbol}: statistic {statistic:.4f}, p {p_value:.4f}"

    def met(self, statistic: float, p_value: float) -> bool:
        return (self.max_p is not None and p_value < self.max_p) or (self.min_statistic is not None and statistic > self.min_statistic)


# The usual rules, their bounds and cooldowns.
DEFAULT_RULES = (
    AlertRule("high_confidence_drift", "critical", max_p=0.01),
    AlertRule("moderate_drift", max_p=0.05, cooldown=600.0),
    AlertRule("large_effect_size", min_statistic=0.5),
)


def samples(df: DataFrame, features: Sequence[str], key: str = "symbol", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """One row per feature that a record has a number for."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    d = df.select(F.col(key).cast("string").alias("symbol"), cells.alias("x"), F.col(ts).cast("timestamp").alias("at"), epoch_us(ts).alias("at_us"),
                  F.col(tie).cast("long").alias("tie"))
    return d.select("symbol", "x.feature", "at", "at_us", "tie", "x.value").filter("value IS NOT NULL AND NOT isnan(value) AND at IS NOT NULL")


def reference_points(df: DataFrame, features: Sequence[str], points: int = 1000, key: str = "symbol", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """The reference's distribution per key and feature: at most ``points`` values with the share of samples up to each.

    A value is taken where the running count passes a multiple of n / points, so of a reference with no more distinct values
    than that nothing is lost, and otherwise the distance found is at most 1 / points too small.
    """
    counts = samples(df, features, key, ts, tie).groupBy("symbol", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "value-counts")
    sizes = counts.groupBy("symbol", "feature").agg(F.sum("n").alias("size"))
    run = running_totals(counts, "value", ["n"], ["symbol", "feature"]).join(sizes, ["symbol", "feature"])
    step = lambda upto: F.floor(upto * points / F.col("size"))
    passed = run.filter(step(F.col("cum_n")) > step(F.col("cum_n") - F.col("n")))
    return passed.select("symbol", "feature", "value", (F.col("cum_n") / F.col("size")).alias("share"), "size")


def _newest(window: int):
    """Of the rows of a task the newest ``window`` of every key; a task with very many keys hands on in parts."""
    def trim(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["at_us", "tie"]).groupby(["symbol", "feature"], sort=False).tail(window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size > TASK_ROWS:
                held = [trim(pd.concat(held))]
                size = len(held[0])
                if size > TASK_ROWS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield trim(pd.concat(held))

    return run


def _thinned(window: int, features: Sequence[str]):
    """``_newest`` for records with a column per feature: these are cut to the newest of every key and feature as Arrow columns,
    some 200,000 records at a time, and only what is left becomes rows per feature."""
    def last(t: pa.Table) -> pa.Table:
        code = t["symbol"].combine_chunks().dictionary_encode().indices.to_numpy()
        tie = pc.fill_null(t["tie"], np.iinfo(np.int64).max).to_numpy()
        order = np.lexsort((tie, t["at_us"].to_numpy(), code))
        ends = np.searchsorted(code[order], code[order], side="right")
        return t.take(order[ends - np.arange(len(t)) <= window])

    def cells(t: pa.Table) -> pa.Table:
        parts = []
        for k, name in enumerate(features):
            there = pc.fill_null(pc.invert(pc.is_nan(t[f"_f{k}"])), False)
            mine = last(t.select(["symbol", "at", "at_us", "tie", f"_f{k}"]).filter(there))
            parts.append(pa.table({"symbol": mine["symbol"], "feature": pa.array([name] * len(mine), pa.string()), "at": mine["at"],
                                   "at_us": mine["at_us"], "tie": mine["tie"], "value": mine[f"_f{k}"]}))
        return pa.concat_tables(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def frames() -> Iterator[pd.DataFrame]:
            nonlocal kind
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size > TASK_ROWS:
                    t, held, size = cells(pa.Table.from_batches(held)), [], 0
                    kind = t.schema
                    yield t.to_pandas()
            if held:
                t = cells(pa.Table.from_batches(held))
                kind = t.schema
                yield t.to_pandas()

        for rows in _newest(window)(frames()):
            yield pa.RecordBatch.from_pandas(rows, schema=kind, preserve_index=False)

    return run


def distance(points: np.ndarray, shares: np.ndarray, values: np.ndarray) -> float:
    """The largest difference between the shares of ``values`` and of the reference up to each point."""
    mine = np.searchsorted(np.sort(values), points, side="right") / len(values)
    return float(np.abs(mine - shares).max())


class Monitor(StatefulProcessor):
    def __init__(self, window: int, min_samples: int, alpha: float, rules: Sequence[AlertRule]):
        self.window, self.min_samples, self.alpha, self.rules = window, min_samples, alpha, tuple(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        field = lambda name, kind: T.StructField(name, kind)
        self.handle = handle
        self.buffer = handle.getListState("buffer", T.StructType([field("at_us", T.LongType()), field("tie", T.LongType()), field("value", T.DoubleType())]))
        self.reference = handle.getListState("reference", T.StructType([field("value", T.DoubleType()), field("share", T.DoubleType()), field("size", T.LongType())]))
        self.fired = handle.getMapState("fired", T.StructType([field("rule", T.StringType())]), T.StructType([field("at_us", T.LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("value")[["value", "share", "size"]]
        self.reference.appendList([(float(v), float(s), int(n)) for v, s, n in rows.itertuples(index=False, name=None)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [pd.DataFrame(list(self.buffer.get()), columns=["at_us", "tie", "value"])] if self.buffer.exists() else []
        for part in rows:  # late samples find their place; only the newest stay
            kept = [pd.concat([*kept, part[["at_us", "tie", "value"]]]).sort_values(["at_us", "tie"], kind="stable").tail(self.window)]
        if not kept:
            return
        buffer = kept[0]
        self.buffer.put([(int(a), int(t), float(v)) for a, t, v in buffer.itertuples(index=False, name=None)])
        if len(buffer) < self.min_samples or not self.reference.exists():
            return
        points, shares, sizes = (np.array(x) for x in zip(*self.reference.get()))
        statistic = distance(points, shares, buffer["value"].to_numpy(dtype="float64"))
        p_value = ks_p(statistic, float(sizes[0]), float(len(buffer)))
        if p_value >= self.alpha:
            return
        now, out = int(buffer["at_us"].iloc[-1]), []
        for rule in self.rules:
            wait = int(rule.cooldown * 1e6)
            if not rule.met(statistic, p_value):
                continue
            if self.fired.containsKey((rule.name,)) and now - self.fired.getValue((rule.name,))[0] < wait:
                continue
            self.fired.updateValue((rule.name,), (now,))
            self.handle.registerTimer((now + wait) // 1000 + 1)
            text = rule.message.format(feature=key[1], symbol=key[0], statistic=statistic, p_value=p_value)
            out.append((key[0], key[1], rule.name, rule.severity, now, statistic, p_value, len(buffer), text))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "feature", "rule", "severity", "at_us", "statistic", "p_value", "samples", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waits = {r.name: int(r.cooldown * 1e6) for r in self.rules}
        over = [name for (name,), (at,) in self.fired.iterator() if now - at >= waits.get(name, 0)]
        for name in over:
            self.fired.removeKey((name,))
        yield from ()

    def close(self) -> None:
        pass


def drift_monitor(df: DataFrame, reference: DataFrame, features: Sequence[str], window: int = 1000, min_samples: int = 100, alpha: float = 0.05,
                  rules: Sequence[AlertRule] = DEFAULT_RULES, late: str = "1 hour", key: str = "symbol", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """Alerts of a stream against ``reference`` (of ``reference_points``): after every batch, each key and feature with new
    samples compares its newest ``window`` samples, at least ``min_samples``, with the reference.

    Run it in update mode.  A key without reference gives no alert.  Records without time, key or number are left out.
    """
    use_rocksdb(df)
    d = df.select(F.col(key).cast("string").alias("symbol"), F.col(ts).cast("timestamp").alias("at"), epoch_us(ts).alias("at_us"), F.col(tie).cast("long").alias("tie"),
                  *[F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(features)]).filter("symbol IS NOT NULL AND at IS NOT NULL")
    d = d.mapInArrow(_thinned(window, list(features)), SAMPLE).withWatermark("at", late)
    alerts = d.groupBy("symbol", "feature").transformWithStateInPandas(
        Monitor(window, min_samples, alpha, rules), ALERT, "update", "eventTime", initialState=reference.groupBy("symbol", "feature"))
    return alerts.withColumn("ts", F.timestamp_micros("at_us").cast("timestamp_ntz")).drop("at_us")
