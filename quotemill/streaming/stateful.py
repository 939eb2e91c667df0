"""Keyed state beyond windows: count windows, running state, live order books, drift alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.operators.ordered import Series
from quotemill.operators.scans import Step, state_scan
from quotemill.session import ROCKSDB

c = F.col
CHUNK = 4096  # windows formed at a time


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one trigger in order: they come in Arrow batches, and only all of them together can be sorted."""
    return pd.concat(list(rows)).sort_values(by, kind="stable", ignore_index=True)


def use_rocksdb(df: DataFrame) -> None:
    """State processors need the RocksDB store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def count_window_processor(size: int, slide: int):
    """Windows of ``size`` rows starting every ``slide`` rows of a key, in arrival order; keeps the open rows only."""

    class CountWindows(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))
            self.rows = handle.getListState("rows", T.StructType([T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            first = self.seen.get()[0] if self.seen.exists() else 0
            kept = np.array(list(self.rows.get()) if self.rows.exists() else [], float).reshape(-1, 2)
            fresh = in_order(rows, ["ts", "tie"])[["price", "volume"]].to_numpy(float)
            kept = np.concatenate([kept, fresh])
            # ``first`` is the position of the first kept row; windows start at multiples of ``slide``.
            done = max((len(kept) - size) // slide + 1, 0)
            for at in range(0, done, CHUNK):
                count = min(CHUNK, done - at)
                rows_of = np.arange(at, at + count)[:, None] * slide + np.arange(size)
                totals = kept[rows_of].sum(axis=1)
                yield pd.DataFrame({"symbol": key[0], "window_id": first // slide + np.arange(at, at + count), "avg_price": totals[:, 0] / size, "volume": totals[:, 1]})
            rest = kept[done * slide:]
            self.seen.update((first + done * slide,))
            self.rows.put([tuple(r) for r in rest.tolist()]) if len(rest) else self.rows.clear()

        def close(self) -> None:
            pass

    return CountWindows()


def count_windows(ticks: DataFrame, size: int, slide: int) -> DataFrame:
    use_rocksdb(ticks)
    return ticks.select("symbol", "ts", "tie", "price", "volume").groupBy("symbol").transformWithStateInPandas(
        count_window_processor(size, slide), "symbol string, window_id long, avg_price double, volume double", "append", "none")


class RunningState(StatefulProcessor):
    """Count, last price and volume, and time of the last update, per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("n", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType()),
                  T.StructField("ts", T.LongType()), T.StructField("tie", T.LongType())]
        self.state = handle.getValueState("state", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, price, volume, ts, tie = self.state.get() if self.state.exists() else (0, 0.0, 0.0, -1, -1)
        for b in rows:
            last = b.sort_values(["at", "tie"]).iloc[-1]
            n += len(b)
            if (last["at"], last["tie"]) > (ts, tie):
                price, volume, ts, tie = float(last["price"]), float(last["volume"]), int(last["at"]), int(last["tie"])
        self.state.update((n, price, volume, ts, tie))
        yield pd.DataFrame([(key[0], n, price, volume, tie)], columns=["symbol", "n", "last_price", "last_volume", "last_tie"])

    def close(self) -> None:
        pass


def running_state(ticks: DataFrame) -> DataFrame:
    from quotemill.operators.ordered import epoch_us

    use_rocksdb(ticks)
    t = ticks.select("symbol", epoch_us("ts").alias("at"), "tie", "price", "volume")
    return t.groupBy("symbol").transformWithStateInPandas(
        RunningState(), "symbol string, n long, last_price double, last_volume double, last_tie long", "update", "none")


class LiveBook(StatefulProcessor):
    """Resting levels of one symbol as map state: updates in sequence order, size 0 removes, stale updates drop."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType())])
        self.levels = handle.getMapState("levels", key, T.StructType([T.StructField("size", T.DoubleType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("sequence", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.last.get()[0] if self.last.exists() else None
        b = in_order(rows, ["ts", "tie"])
        sequence = b["sequence"].to_numpy(np.int64)
        top = np.maximum.accumulate(sequence if had is None else np.maximum(sequence, had))
        last = int(top[-1])
        # A row is new where it exceeds all before it.
        before = np.concatenate([[had if had is not None else sequence[0] - 1], top[:-1]])
        newest = b[sequence > before].drop_duplicates(["side", "price"], keep="last")
        touched = {(r.side, float(r.price)): float(r.size) for r in newest.itertuples(index=False)}
        for level, size in touched.items():
            if size == 0:
                if self.levels.containsKey(level):
                    self.levels.removeKey(level)
            else:
                self.levels.updateValue(level, (size,))
        self.last.update((last,))
        book = [(key[0], k[0], k[1], v[0]) for k, v in self.levels.iterator()] if touched else []
        if book:
            yield pd.DataFrame(book, columns=["symbol", "side", "price", "size"]).assign(sequence=last)

    def close(self) -> None:
        pass


def live_book(deltas: DataFrame, tick: float) -> DataFrame:
    """Whole book of a symbol after every batch that changes it; the newest sequence is the current book."""
    from quotemill.functions.scalars import tick_align

    use_rocksdb(deltas)
    d = deltas.withColumn("price", tick_align("price", tick))
    return d.groupBy("symbol").transformWithStateInPandas(
        LiveBook(), "symbol string, side string, price double, size double, sequence long", "update", "none")


def _cooldown_step(cooldown: float) -> Step:
    def step(cols, state):
        import numpy as np

        last = state[0] if state else float("-inf")
        fired = []
        for at, on in zip(cols["_at_s"].tolist(), cols["_hot"].tolist()):
            go = bool(on) and at - last >= cooldown
            last = at if go else last
            fired.append(1.0 if go else 0.0)
        return {"fired": np.array(fired)}, [last]

    return step


def alerts_with_cooldown(scores: DataFrame, s: Series, condition, cooldown: float) -> DataFrame:
    """Rows where a rule fires: the condition holds and the last firing is at least ``cooldown`` seconds ago."""
    from quotemill.operators.ordered import epoch_us

    d = scores.withColumns({"_hot": condition.cast("double"), "_at_s": epoch_us(s.ts) / F.lit(1e6)})
    out = state_scan(d, s, ["_at_s", "_hot"], _cooldown_step(cooldown), ["fired"])
    return out.filter("fired = 1").drop("_at_s", "_hot", "fired")
