"""Regimes as a chain of hidden states with normal values: fitting, smoothed probabilities and the likeliest path.

One step of the chain is a small matrix (the move, weighted by how likely each state makes the row's value).  Products of
such matrices are associative, in the usual arithmetic (sums over paths) and with maxima in place of sums (best path).
So every block of rows folds to one matrix; the matrices of a key's blocks, few and small, tell each block what came
before and what comes after it; and inside a block running products are formed by doubling, all rows at once.  A key
that holds most rows is spread over its blocks like any other.

All in logarithms.  A missing value is as likely in every state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordered import Series, index_rows
from quotemill.session import materialize

BLOCK = 4096
REGIMES = ("bear", "sideways", "bull")


@dataclass(frozen=True)
class Chain:
    """``start`` (k), ``move`` (k x k, from row to column), ``mean`` and ``sd`` of the values in each state (k)."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        """Log density of every value in every state."""
        z = (x[:, None] - self.mean) / self.sd
        return np.where(np.isnan(z), 0.0, -0.5 * z * z - np.log(self.sd) - 0.5 * np.log(2 * np.pi))

    def steps(self, x: np.ndarray, first: bool) -> np.ndarray:
        """The matrix of every row; the first row of a key forgets where it comes from."""
        with np.errstate(divide="ignore"):
            move, start = np.log(self.move), np.log(self.start)
        out = move[None] + self.likelihoods(x)[:, None, :]
        if first and len(x):
            out[0] = start + self.likelihoods(x[:1])[0]
        return out


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis)) + np.squeeze(top, axis)


def _max(a: np.ndarray, axis: int) -> np.ndarray:
    return a.max(axis)


def times(a: np.ndarray, b: np.ndarray, add: Callable) -> np.ndarray:
    """Products of stacks of matrices, with ``add`` over the paths."""
    return add(a[..., :, :, None] + b[..., None, :, :], -2)


def running(m: np.ndarray, add: Callable, backwards: bool = False) -> np.ndarray:
    """Products of the matrices up to each place (or from each place to the end), by doubling."""
    out, step = m.copy(), 1
    while step < len(out):
        if backwards:
            out[:-step] = times(out[:-step], out[step:], add)
        else:
            out[step:] = times(out[:-step], out[step:], add)
        step *= 2
    return out


def _packed(df: DataFrame, s: Series, value: str, block: int) -> DataFrame:
    """One row per key and block: its rows in order and their values."""
    keys = list(s.keys)
    rows = index_rows(df.select(*keys, s.ts, *s.tie, F.col(value).cast("double").alias("_x")), s)
    held = F.sort_array(F.collect_list(F.struct("_i", s.ts, *s.tie, "_x")))
    return rows.groupBy(*keys, F.floor(F.col("_i") / block).alias("_block")).agg(held.alias("_rows")).withColumn("_xs", F.col("_rows._x"))


def _values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for xs in batch.column(batch.schema.get_field_index("_xs")):
        yield np.array([np.nan if v is None else v for v in xs.as_py()], float)


def _fold(chain: Chain, add: Callable):
    """Every block as one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_block")
            out = [running(chain.steps(x, b == 0), add)[-1].ravel() for x, b in zip(_values(batch), batch.column(at).to_pylist())]
            rest = [k for k in range(batch.num_columns) if k != batch.schema.get_field_index("_xs")]
            cols = [*[batch.column(k) for k in rest], pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*[batch.schema.names[k] for k in rest], "_m"])

    return run


def _surroundings(k: int, add: Callable, keys: list[str]):
    """Per key, over its blocks: the log weights of the states before and after each block and, for the best path, the states
    it has there.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        m = np.stack([np.asarray(x, float).reshape(k, k) for x in pdf["_m"]])
        upto = running(m, add)
        begin = np.full(k, -np.log(k)) if add is _sum else np.zeros(k)
        ends = add(begin[None, :, None] + upto, 1)
        before = np.vstack([begin, ends[:-1]])
        after = np.vstack([add(running(m, add, backwards=True), 2)[1:], np.zeros(k)])
        states = np.zeros(len(m) + 1, int)
        states[-1] = int(ends[-1].argmax())
        for b in range(len(m) - 1, 0, -1):  # a step per block
            states[b] = int((before[b] + m[b][:, states[b + 1]]).argmax())
        out = pdf[[*keys, "_block"]].copy()
        return out.assign(_before=list(before), _after=list(after), _from=states[:-1].astype("int64"), _to=states[1:].astype("int64"), _fit=float(add(ends[-1][None], 1)[0]))

    return run


def _with_surroundings(packed: DataFrame, s: Series, chain: Chain, add: Callable) -> DataFrame:
    keys, k = list(s.keys), len(chain.mean)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    ids = ", ".join(f"`{x}` {kinds[x]}" for x in [*keys, "_block"])
    folded = packed.select(*keys, "_block", "_xs").mapInArrow(_fold(chain, add), f"{ids}, _m array<double>")
    around = folded.groupBy(*keys).applyInPandas(
        _surroundings(k, add, keys), f"{ids}, _before array<double>, _after array<double>, _from bigint, _to bigint, _fit double")
    return packed.join(around, [*keys, "_block"])


def _weights(chain: Chain, x: np.ndarray, first: bool, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of a block, and the log weights of all paths up to and from each row."""
    m = chain.steps(x, first)
    ahead = _sum(before[None, :, None] + running(m, _sum), 1)
    behind = np.vstack([_sum(running(m, _sum, backwards=True) + after[None, None, :], 2)[1:], after[None]])
    return m, ahead, behind


def _shares(log: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    w = np.exp(log - log.max(axes, keepdims=True))
    return w / w.sum(axes, keepdims=True)


def _counts(chain: Chain):
    """Per block: expected visits, sums of values and squares, first states, and moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(chain.mean)
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            out = []
            for x, block, before, after, fit in zip(_values(batch), col("_block"), col("_before"), col("_after"), col("_fit")):
                before, after = np.array(before), np.array(after)
                m, ahead, behind = _weights(chain, x, block == 0, before, after)
                visits = _shares(ahead + behind, (1,))
                come = np.vstack([before[None], ahead[:-1]])
                moves = _shares(come[:, :, None] + m + behind[:, None, :], (1, 2))
                there = ~np.isnan(x)
                w, v = visits[there], x[there][:, None]
                start, rest = (visits[0], moves[1:]) if block == 0 else (np.zeros(k), moves)
                out.append(np.concatenate([start, rest.sum(0).ravel(), w.sum(0), (w * v).sum(0), (w * v * v).sum(0), [fit if block == 0 else 0.0]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["_counts"])

    return run


def fit_chain(df: DataFrame, s: Series, value: str, k: int = 3, rounds: int = 10, stay: float = 0.9, block: int = BLOCK) -> tuple[Chain, list[float]]:
    """Expectation and maximisation from spread-out means; one chain for all keys.  Returns it with the log likelihood of each round.

    A round folds, surrounds and counts; k + k * k + 3 k + 1 sums reach the driver.  States are sorted by their mean.
    """
    x = F.col(value).cast("double")
    levels = [(i + 0.5) / k for i in range(k)]
    first = df.select(F.percentile_approx(x, F.array(*[F.lit(p) for p in levels]), 10_000).alias("q"), F.stddev_samp(x).alias("sd")).first()
    if first["q"] is None or not first["sd"]:
        raise ValueError("a chain needs values that differ")
    chain = Chain(np.full(k, 1 / k), np.full((k, k), (1 - stay) / (k - 1)) * (1 - np.eye(k)) + stay * np.eye(k), np.array(first["q"], float), np.full(k, first["sd"]))
    floor = 1e-3 * first["sd"]
    packed, fits = materialize(_packed(df, s, value, block), "chain-rows"), []
    for _ in range(rounds):
        counts = _with_surroundings(packed, s, chain, _sum).select("_block", "_xs", "_before", "_after", "_fit").mapInArrow(_counts(chain), "_counts array<double>")
        size = k + k * k + 3 * k + 1
        row = counts.agg(*[F.sum(F.get("_counts", F.lit(i))) for i in range(size)]).first()
        start, moves, n, total, squares, fit = np.split(np.array(row, float), np.cumsum([k, k * k, k, k, k]))
        moves, n = moves.reshape(k, k), np.maximum(n, 1e-12)
        mean = total / n
        sd = np.sqrt(np.maximum(squares / n - mean * mean, floor * floor))
        chain = Chain(start / start.sum(), (moves + 1e-12) / (moves + 1e-12).sum(1, keepdims=True), mean, sd)
        fits.append(float(fit[0]))
    order = np.argsort(chain.mean)
    return Chain(chain.start[order], chain.move[np.ix_(order, order)], chain.mean[order], chain.sd[order]), fits


def _paths(chain: Chain):
    """Per block the states of the best path, which begins and ends in the states given for the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            out = []
            for x, block, source, goal in zip(_values(batch), col("_block"), col("_from"), col("_to")):
                m = chain.steps(x, block == 0)
                best = running(m, _max)[:, source, :]
                # The state before each row, for every state the row may have; the chain of these is followed by doubling too.
                back = (best[:-1][:, :, None] + m[1:]).argmax(1)
                step = 1
                while step < len(back):
                    back[:-step] = np.take_along_axis(back[:-step], back[step:], 1)
                    step *= 2
                out.append([*back[:, goal].tolist(), goal])
            rest = [k for k, name in enumerate(batch.schema.names) if name not in ("_xs", "_before", "_after", "_from", "_to", "_fit")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], pa.array(out, pa.list_(pa.int32()))],
                                             [*[batch.schema.names[k] for k in rest], "_states"])

    return run


def likeliest_path(df: DataFrame, s: Series, value: str, chain: Chain, block: int = BLOCK) -> DataFrame:
    """Keys, time, ties, the value and ``state``: the states of the single most likely path of each key."""
    keys = list(s.keys)
    around = _with_surroundings(materialize(_packed(df, s, value, block), "chain-rows"), s, chain, _max)
    kinds = {f.name: f.dataType.simpleString() for f in around.schema.fields}
    kept = [x for x in around.columns if x not in ("_xs", "_before", "_after", "_from", "_to", "_fit")]
    states = around.mapInArrow(_paths(chain), ", ".join(f"`{x}` {kinds[x]}" for x in kept) + ", _states array<int>")
    cell = states.select(*keys, F.explode(F.arrays_zip("_rows", "_states")).alias("c"))
    return cell.select(*keys, *[F.col(f"c._rows.{x}").alias(x) for x in (s.ts, *s.tie)], F.col("c._rows._x").alias(value), F.col("c._states").alias("state"))


def _smoothed(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            out = []
            for x, block, before, after in zip(_values(batch), col("_block"), col("_before"), col("_after")):
                _, ahead, behind = _weights(chain, x, block == 0, np.array(before), np.array(after))
                out.append(_shares(ahead + behind, (1,)).tolist())
            rest = [k for k, name in enumerate(batch.schema.names) if name not in ("_xs", "_before", "_after", "_from", "_to", "_fit")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], pa.array(out, pa.list_(pa.list_(pa.float64())))],
                                             [*[batch.schema.names[k] for k in rest], "_p"])

    return run


def state_probabilities(df: DataFrame, s: Series, value: str, chain: Chain, block: int = BLOCK) -> DataFrame:
    """Keys, time, ties, the value and ``p``: the probability of every state given the whole series of the key."""
    keys = list(s.keys)
    around = _with_surroundings(materialize(_packed(df, s, value, block), "chain-rows"), s, chain, _sum)
    kinds = {f.name: f.dataType.simpleString() for f in around.schema.fields}
    kept = [x for x in around.columns if x not in ("_xs", "_before", "_after", "_from", "_to", "_fit")]
    rows = around.mapInArrow(_smoothed(chain), ", ".join(f"`{x}` {kinds[x]}" for x in kept) + ", _p array<array<double>>")
    cell = rows.select(*keys, F.explode(F.arrays_zip("_rows", "_p")).alias("c"))
    return cell.select(*keys, *[F.col(f"c._rows.{x}").alias(x) for x in (s.ts, *s.tie)], F.col("c._rows._x").alias(value), F.col("c._p").alias("p"))
