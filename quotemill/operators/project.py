"""Projection, filtering and composition over whole DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

Transform = Callable[[DataFrame], DataFrame]
FAILURES_KEPT = 100_000  # failed inputs a task remembers


def compose(*steps: Transform) -> Transform:
    """Left-to-right chain of DataFrame transforms."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)


def map_columns(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(cols))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arbitrary Python over Arrow batches; Spark's partitions are the parallelism."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def _tried(fn: Callable[[pd.DataFrame], pd.Series], b: pd.DataFrame) -> tuple[list, list]:
    """Values and errors of a batch; where it fails, of its halves, down to the rows that fail by themselves."""
    if not len(b):
        return [], []
    try:
        out = list(fn(b))
        if len(out) != len(b):
            raise ValueError(f"{len(out)} values for {len(b)} rows")
        return out, [None] * len(b)
    except Exception as e:  # noqa: BLE001 - any failure of the user's function is data here
        if len(b) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
        half = len(b) // 2
        parts = [_tried(fn, part) for part in (b.iloc[:half], b.iloc[half:])]
        return [v for values, _ in parts for v in values], [x for _, errors in parts for x in errors]


def _row_keys(b: pd.DataFrame) -> list[tuple]:
    """One key per row; equal keys mean the same bits of numbers and the same type and value of anything else."""
    def column(x: pd.Series) -> list:
        if isinstance(x.dtype, np.dtype) and x.dtype.kind in "fM":
            return x.to_numpy().view(f"i{x.dtype.itemsize}").tolist()
        return x.tolist() if isinstance(x.dtype, np.dtype) and x.dtype.kind in "iub" else list(zip(map(type, x), x))

    return list(zip(*[column(b[n]) for n in b.columns]))


def _asker(fn: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str] | None):
    """``_tried`` for the batches of a task.  With ``inputs`` named, ``fn`` sees these columns only; in a batch that fails
    rows of equal inputs are asked once, in the order of the inputs (so that failing rows lie together), and rows that
    failed before are not asked again."""
    failed: dict[tuple, str] = {}

    def ask(b: pd.DataFrame) -> tuple[list, list]:
        if inputs is None:
            return _tried(fn, b)
        part = b[list(inputs)]
        try:
            out = list(fn(part))
            if len(out) == len(b):
                return out, [None] * len(b)
        except Exception:  # noqa: BLE001, S110 - asked again below, in parts
            pass
        try:
            keys = _row_keys(part)
            first: dict[tuple, int] = {}
            for k, key in enumerate(keys):
                first.setdefault(key, k)
            new = part.iloc[[k for key, k in first.items() if key not in failed]].sort_values(list(inputs), kind="stable")
        except TypeError:  # inputs that have no hash or no order
            return _tried(fn, part)
        found = dict(zip(_row_keys(new), zip(*_tried(fn, new))))
        answers = [found[key] if key in found else (None, failed[key]) for key in keys]
        if len(failed) > FAILURES_KEPT:
            failed.clear()
        failed.update({key: error for key, (_, error) in found.items() if error is not None})
        return [v for v, _ in answers], [e for _, e in answers]

    return ask


def map_or_error(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], out: str, out_type: str, inputs: Sequence[str] | None = None) -> DataFrame:
    """Apply ``fn`` to each batch; a batch that fails is halved until the failing rows stand alone, which keep their error.

    ``fn`` gives a value per row that depends on that row only, and of that only on ``inputs`` where these are named:
    many failing rows that repeat each other are then cheap.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{out} {out_type}", "error string"])

    def run(batches):
        ask = _asker(fn, inputs)
        for b in batches:
            values, errors = ask(b)
            yield b.assign(**{out: values, "error": errors})

    return df.mapInPandas(run, schema)


def named_features(df: DataFrame, features: Mapping[str, Callable[[pd.DataFrame], pd.Series]], inputs: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Named user functions, one double column each, and ``errors``: per feature that failed on a row its message.

    ``inputs`` names the columns a feature reads, as for ``map_or_error``; first the one that decides about failure.
    """
    inputs = inputs or {}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in features] + ["errors map<string,string>"])

    def run(batches):
        askers = {name: _asker(fn, inputs.get(name)) for name, fn in features.items()}
        for b in batches:
            got = {name: ask(b) for name, ask in askers.items()}
            errors = [{name: e[k] for name, (_, e) in got.items() if e[k] is not None} for k in range(len(b))]
            columns = {name: pd.array([None if v is None or v != v else float(v) for v in values], dtype="Float64") for name, (values, _) in got.items()}
            yield b.assign(**columns, errors=errors)

    return df.mapInPandas(run, schema)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("error IS NULL").drop("error"), df.filter("error IS NOT NULL")


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """SQL over named DataFrames, with named parameters."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or None)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
