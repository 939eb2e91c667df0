"""User-defined functions: scalar, array, folds that merge, and a table function."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.bars import vwap_arrays


def register_scalar(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str) -> None:
    """Make an Arrow-batched function callable from SQL.

    A NaN that ``fn`` gives for whole arguments stays NaN; where an argument is missing it is null.
    """
    def told_apart(*args: pd.Series) -> pd.Series:
        out = fn(*args)
        if out.dtype.kind != "f" or pd.api.types.is_extension_array_dtype(out.dtype):
            return out
        missing = np.logical_or.reduce([a.isna().to_numpy() for a in args]) & out.isna().to_numpy()
        return pd.Series(pd.arrays.FloatingArray(out.to_numpy(), missing))

    spark.udf.register(name, F.pandas_udf(told_apart, returns))


def array_vwap(prices: str, volumes: str) -> Column:
    """Native; no Python involved."""
    return vwap_arrays(F.col(prices), F.col(volumes))


Lift = Callable[[np.ndarray], np.ndarray]
Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]
TABLE_KEYS = 100_000
LANES = 64


def _reduced(keys: pd.DataFrame, states: np.ndarray, merge: Merge) -> tuple[pd.DataFrame, np.ndarray]:
    """One state per key, in the order of first appearance: neighbours of a key are merged, all keys at once, until one is left."""
    code = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    code, states = code[order], states[order]
    first = order[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else order
    while len(code):
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        if len(begins) == len(code):
            break
        at = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        left = np.flatnonzero((at % 2 == 0) & (np.append(code[1:], -1) == code))
        keep = at % 2 == 0
        states[left] = merge(states[left], states[left + 1])
        code, states = code[keep], states[keep]
    return keys.iloc[first].reset_index(drop=True), states


def fold(df: DataFrame, keys: Sequence[str], value: str, lift: Lift, merge: Merge, width: int = 1,
         finish: Callable[[np.ndarray], np.ndarray] | None = None, out: str = "folded", table_keys: int = TABLE_KEYS) -> DataFrame:
    """User fold per key: ``lift`` turns n values into n states of ``width`` numbers, ``merge`` joins n states with n others
    (it must be associative and not mind the order), ``finish`` makes a number of each final state (by default its first).

    Whole batches are lifted and merged at a time.  A task keeps one state per key in a table that is handed on when it
    holds ``table_keys``; states then meet in two steps, first in ``LANES`` lanes of a key, then per key, read in key order, so
    neither a key with most rows nor many keys gather in memory.  Null values are left out; a null key is a key; without
    any value a key is absent.
    """
    keys, names = list(keys), [f"_s{i}" for i in range(width)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ids = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{ids}, " + ", ".join(f"{n} double" for n in names)

    def framed(at: pd.DataFrame, states: np.ndarray) -> pd.DataFrame:
        return at.assign(**{n: states[:, i] for i, n in enumerate(names)})

    def meet(held: pd.DataFrame | None, more: pd.DataFrame) -> pd.DataFrame:
        both = more if held is None else pd.concat([held, more], ignore_index=True)
        return framed(*_reduced(both[keys], both[names].to_numpy(float).copy(), merge))

    def lifted(batches):
        held = None
        for b in batches:
            states = np.asarray(lift(b[value].to_numpy(float)), float).reshape(len(b), width)
            held = meet(held, framed(b[keys], states))
            if len(held) >= table_keys:
                yield held
                held = None
        if held is not None:
            yield held

    def met(batches):
        """States of sorted keys: all but the last key of a batch are complete."""
        held = None
        for b in batches:
            held = meet(held, b)
            if len(held) > 1:
                yield held.iloc[:-1]
                held = held.iloc[-1:]
        if held is not None:
            yield held

    rows = df.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    parts = rows.mapInPandas(lifted, schema).withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    lanes = parts.repartition(*keys, "_lane").sortWithinPartitions(*keys).drop("_lane").mapInPandas(met, schema)
    final = lanes.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(met, schema)
    if finish is None:
        return final.select(*keys, F.col(names[0]).alias(out))

    @F.pandas_udf("double")
    def finished(*cols: pd.Series) -> pd.Series:
        return pd.Series(finish(np.column_stack([x.to_numpy(float) for x in cols])))

    return final.select(*keys, finished(*names).alias(out))


@F.udtf(returnType="level int, price double, size double")
class BookLevels:
    """Table function: price levels around a mid price."""

    def eval(self, mid: float, size: float, depth: int):
        for k in range(1, depth + 1):
            yield k, mid * (1 - k / 1000.0), size + k


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("book_levels", BookLevels)
