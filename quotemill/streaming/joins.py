"""Join of two streams whose memory is bounded per key: the newest rows of either side, for a limited time.

A row meets the rows of the other side that came before it and are still held.  Of a key and side at most ``cap`` rows are held,
the oldest giving way, and none that is older than ``expire`` seconds of event time; an event-time timer clears
a key that has gone quiet.  A row that meets nothing comes out at once, alone, if the kind of join keeps its side.

Inside a batch rows come in the order of time and tie; a late row comes after all rows of earlier batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.operators.ordered import epoch_us
from quotemill.streaming.stateful import use_rocksdb

# Formats that keep microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
KINDS = ("inner", "left", "right", "full")


def _met(held: int, order: np.ndarray, other: np.ndarray, at: np.ndarray, theirs_at: np.ndarray, cap: int, expire_us: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each fresh row of one side (at place ``order``, time ``at``) the rows of the other that it meets: positions among
    the fresh rows and among the ``held`` and fresh ones of the other side (fresh at place ``other``, all at ``theirs_at``)."""
    before = held + np.searchsorted(other, order)
    first = np.maximum(before - cap, 0)
    sizes = before - first
    mine = np.repeat(np.arange(len(order)), sizes)
    ends = np.cumsum(sizes)
    theirs = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
    if expire_us is not None and len(mine):
        alive = theirs_at[theirs] >= at[mine] - expire_us
        mine, theirs = mine[alive], theirs[alive]
    return mine, theirs


class CappedJoin(StatefulProcessor):
    def __init__(self, cap: int, expire: float | None, how: str, keys: Sequence[str]):
        self.cap, self.how, self.keys = cap, how, list(keys)
        self.expire_us = None if expire is None else int(expire * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = T.StructType([T.StructField("at_us", T.LongType()), T.StructField("row", T.StringType())])
        self.handle = handle
        self.sides = [handle.getListState(name, row) for name in ("left", "right")]
        self.alarm = handle.getValueState("alarm", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Most keys have few rows of a batch: arrays, because frames would cost more than the work.
        parts = list(rows)
        at_us, tie, side, text = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("at_us", "tie", "side", "row"))
        order = np.lexsort((side, tie, at_us))
        at_us, side, text = at_us[order], side[order], text[order].astype(object)
        place = [np.flatnonzero(side == k) for k in (0, 1)]
        held = [list(s.get()) if s.exists() else [] for s in self.sides]
        times = [np.concatenate([np.array([a for a, _ in h], np.int64), at_us[p]]) for h, p in zip(held, place)]
        texts = [np.concatenate([np.array([r for _, r in h], object), text[p]]) for h, p in zip(held, place)]
        out = ([], [])
        for k, keeps in ((0, ("left", "full")), (1, ("right", "full"))):
            mine, theirs = _met(len(held[1 - k]), place[k], place[1 - k], at_us[place[k]], times[1 - k], self.cap, self.expire_us)
            fresh = text[place[k]]
            out[k].append(fresh[mine])
            out[1 - k].append(texts[1 - k][theirs])
            if self.how in keeps:
                alone = np.ones(len(fresh), bool)
                alone[mine] = False
                out[k].append(fresh[alone])
                out[1 - k].append(np.full(int(alone.sum()), None, object))
        newest = int(at_us[-1])
        for k, state in enumerate(self.sides):
            if not len(place[k]) and (self.expire_us is None or all(a >= newest - self.expire_us for a, _ in held[k])):
                continue  # nothing came and nothing has expired
            kept = list(zip(times[k][-self.cap:].tolist(), texts[k][-self.cap:].tolist()))
            if self.expire_us is not None:
                kept = [x for x in kept if x[0] >= newest - self.expire_us]
            state.put(kept) if kept else state.clear()
        if self.expire_us is not None:
            if self.alarm.exists():
                self.handle.deleteTimer(self.alarm.get()[0])
            wake = (newest + self.expire_us) // 1000 + 1
            self.handle.registerTimer(wake)
            self.alarm.update((wake,))
        left, right = (np.concatenate(x) for x in out)
        if len(left):
            yield pd.DataFrame({**dict(zip(self.keys, key)), "l": left, "r": right})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.sides, self.alarm):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def capped_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cap: int = 1000, expire: float | None = None, how: str = "inner",
                late: str = "5 minutes", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """Keys and structs ``l`` and ``r``: the rows of both sides, or null for the side that a row met nothing of.

    Both sides have the keys, ``ts`` and ``tie``.  Rows with a null key or time meet nothing and are left out.  Run it in
    update mode.
    """
    if how not in KINDS:
        raise ValueError(f"how is one of {KINDS}")
    use_rocksdb(left)
    keys = list(keys)

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(*keys, F.lit(number).alias("side"), F.col(ts).cast("timestamp").alias("at"), epoch_us(ts).cast("bigint").alias("at_us"),
                         F.col(tie).cast("bigint").alias("tie"), F.to_json(F.struct(*df.columns), _TIMES).alias("row"))

    there = F.col("at").isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    both = side(left, 0).unionByName(side(right, 1)).filter(there).withWatermark("at", late)
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    pairs = both.groupBy(*keys).transformWithStateInPandas(CappedJoin(cap, expire, how, keys), f"{kinds}, l string, r string", "update", "eventTime")
    return pairs.select(*keys, F.from_json("l", left.schema, _TIMES).alias("l"), F.from_json("r", right.schema, _TIMES).alias("r"))
