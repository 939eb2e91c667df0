"""Co-moments of many columns at once: a blocked Gram matrix summed over the tasks that read the rows.

Every task multiplies the rows it reads into blocks of X'X, so its output does not grow with its rows; blocks of the
same place are added up by whichever task they are dealt to.  Plans stay the same size for any number of
columns, and work per row is matrix multiplication.  Values are shifted by the column means first, which keeps sums of squares
from cancelling.  Missing values are left out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
MAX_COLUMNS = 8192
_BLOCKS = "bi int, bj int, sums array<double>"
_CELLS = "i int, j int, n double, mean_i double, mean_j double, c_ii double, c_jj double, c_ij double"
_CELL_NAMES = [c.split()[0] for c in _CELLS.split(", ")]


def vector(cols: Sequence[str | Column]) -> Column:
    """The columns as one array of doubles."""
    return F.array(*[(F.col(f"`{x}`") if isinstance(x, str) else x).cast("double") for x in cols])


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a batch of arrays, 0 where missing, and 1 where there is one."""
    flat = batch.column(0).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    there = np.ones(x.shape) if flat.null_count == 0 else flat.is_valid().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.where(there > 0, x, 0.0), there


def _column_sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(width), np.zeros(width)
        for batch in batches:
            x, there = _matrix(batch, width)
            n, total = n + there.sum(0), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(n), pa.array(total)], ["i", "n", "total"])

    return run


def _blocks(shift: np.ndarray, block: int):
    width = len(shift)
    cuts = [(a, min(a + block, width)) for a in range(0, width, block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, there = _matrix(batch, width)
            x = (x - shift) * there
            square = x * x
            for i, (a, b) in enumerate(cuts):
                for j, (p, q) in enumerate(cuts[i:], i):
                    xi, mi, si, xj, mj, sj = x[:, a:b], there[:, a:b], square[:, a:b], x[:, p:q], there[:, p:q], square[:, p:q]
                    part = np.stack([mi.T @ mj, xi.T @ mj, mi.T @ xj, si.T @ mj, mi.T @ sj, xi.T @ xj])
                    sums[i, j] = part if (i, j) not in sums else sums[i, j] + part
        for (i, j), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], ["bi", "bj", "sums"])

    return run


def _cells(shift: np.ndarray, block: int):
    """Blocks of one place added up; then one row per pair of columns, the diagonal and above."""
    width = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, s in zip(*(batch.column(k) for k in range(3))):
                key, part = (i.as_py(), j.as_py()), s.values.to_numpy(zero_copy_only=False)
                total[key] = part.copy() if key not in total else total[key] + part
        for (bi, bj), flat in total.items():
            i, j = np.indices((min(block, width - bi * block), min(block, width - bj * block)))
            i, j = (i + bi * block).ravel(), (j + bj * block).ravel()
            keep = (i <= j) & (flat.reshape(6, -1)[0] > 0)  # pairs that no row has both of give no row
            i, j = i[keep], j[keep]
            n, si, sj, sii, sjj, sij = flat.reshape(6, -1)[:, keep]
            cols = [n, shift[i] + si / n, shift[j] + sj / n, sii - si * si / n, sjj - sj * sj / n, sij - si * sj / n]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(x) for x in cols]], _CELL_NAMES)

    return run


def co_moments(df: DataFrame, values: Column, width: int, block: int = BLOCK) -> DataFrame:
    """Per pair i <= j of places in the array ``values`` (all of length ``width``): the rows ``n`` that have both, the two means,
    and the centred sums ``c_ii``, ``c_jj`` and ``c_ij`` over these rows.
    """
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns; a task holds at most the co-moments of {MAX_COLUMNS}")
    if width == 0:
        return df.sparkSession.createDataFrame([], _CELLS)
    rows = df.select(values.alias("x"))
    sums = rows.mapInArrow(_column_sums(width), "i int, n double, total double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    shift = np.zeros(width)
    for r in sums.collect():  # one row per column
        shift[r["i"]] = r["total"] / r["n"] if r["n"] and np.isfinite(r["total"]) else 0.0
    return rows.mapInArrow(_blocks(shift, block), _BLOCKS).repartition("bi", "bj").mapInArrow(_cells(shift, block), _CELLS)


def named(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The pairs with the names ``a`` and ``b`` of their places."""
    table = pairs.sparkSession.createDataFrame(list(enumerate(names)), "k int, name string")
    return (pairs.join(F.broadcast(table.withColumnsRenamed({"k": "i", "name": "a"})), "i")
            .join(F.broadcast(table.withColumnsRenamed({"k": "j", "name": "b"})), "j"))


def correlation() -> Column:
    """Of a pair's co-moments; null where either column does not vary."""
    return F.try_divide(F.col("c_ij"), F.sqrt(F.col("c_ii") * F.col("c_jj")))


def covariance() -> Column:
    """Sample covariance of a pair's co-moments; null with fewer than two rows."""
    return F.try_divide(F.col("c_ij"), F.col("n") - 1)


def as_matrix(pairs: DataFrame, width: int, cell: Column) -> np.ndarray:
    """A symmetric matrix on the driver: ``width`` x ``width`` numbers, for algebra on panels."""
    out = np.full((width, width), np.nan)
    got = pairs.select("i", "j", cell.cast("double").alias("v")).toArrow()
    i, j, v = (got.column(k).to_numpy() for k in range(3))
    out[i, j] = out[j, i] = v
    return out
