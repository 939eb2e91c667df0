"""Recurrences that are not linear, run block by block.

A block of rows cannot know the state its predecessor ends in, so it first guesses it by running over a few
rows of that predecessor.  Wrong guesses are then found by comparing each block's start with the end of the
block before, and only those blocks run again, until all starts agree: the result equals one pass over the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordered import Panel, Series, index_rows
from quotemill.session import materialize

# step(columns, state or None) -> (output columns, end state)
Step = Callable[[dict[str, np.ndarray], "list[float] | None"], "tuple[dict[str, np.ndarray], list[float]]"]


def state_scan(df: DataFrame, s: Series, cols: Sequence[str], step: Step, outs: Sequence[str],
               warm: int = 512, indexed: bool = False) -> DataFrame:
    keys, b, cols, outs = list(s.keys), s.block_rows, list(cols), list(outs)
    df = df if indexed else index_rows(df, s)
    ids = [*keys, s.ts, *s.tie]
    rows = materialize(df.select(*ids, *cols, "_i", F.floor(F.col("_i") / b).alias("_block")), "scan-rows")
    by = [*keys, "_block"]
    schema = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    bound_schema = ", ".join([f"`{k}` {schema[k]}" for k in by] + ["_start array<double>", "_end array<double>"])

    def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: pdf[c].to_numpy() for c in cols}

    def bound(pdf: pd.DataFrame, start, end) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "_start": [start], "_end": [end]})

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = pdf["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame()
        start = step(arrays(pdf[~own]), None)[1] if (~own).any() else None
        return bound(pdf, start, step(arrays(pdf[own]), start)[1])

    first = F.floor(F.col("_i") / b)
    spread = rows.drop("_block").withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_i") + warm) / b))))
    spread = spread.withColumn("_own", F.col("_block") == first).select(*by, *cols, "_i", "_own")
    bounds = materialize(spread.groupBy(*by).applyInPandas(guess, bound_schema), "scan-bounds")

    while True:
        given = bounds.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_given"))
        wrong = bounds.join(given, by).filter(~F.col("_start").eqNullSafe(F.col("_given"))).select(*by, "_given")
        if wrong.isEmpty():
            break
        wrong = materialize(wrong, "scan-wrong")

        def redo(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if right.empty:
                return pd.DataFrame()
            start = list(right["_given"].iloc[0])
            return bound(right, start, step(arrays(left.sort_values("_i")), start)[1])

        need = rows.join(wrong.select(*by), by, "left_semi")
        again = need.groupBy(*by).cogroup(wrong.groupBy(*by)).applyInPandas(redo, bound_schema)
        bounds = materialize(bounds.join(wrong, by, "left_anti").unionByName(again), "scan-bounds")

    out_schema = ", ".join([f"`{k}` {schema[k]}" for k in [*ids, *cols]] + [f"{o} double" for o in outs])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_i")
        start = right["_start"].iloc[0]
        got, _ = step(arrays(left), None if start is None else list(start))
        return left[[*ids, *cols]].assign(**{o: got[o] for o in outs})

    return rows.groupBy(*by).cogroup(bounds.groupBy(*by)).applyInPandas(run, out_schema)


def _psar_step(accel: float, limit: float) -> Step:
    def step(cols, state):
        high, low = cols["high"].tolist(), cols["low"].tolist()
        out = [float("nan")] * len(high)
        first = 0
        if state is None:
            state, first = [1.0, low[0], high[0], accel, high[0], low[0], high[0], low[0]], 1
        trend, sar, ep, af, h1, l1, h2, l2 = state
        for i in range(first, len(high)):
            h, lo = high[i], low[i]
            sar += af * (ep - sar)
            if trend > 0:
                sar = min(sar, l1, l2)
                if lo < sar:
                    trend, sar, ep, af = -1.0, ep, lo, accel
                elif h > ep:
                    ep, af = h, min(af + accel, limit)
            else:
                sar = max(sar, h1, h2)
                if h > sar:
                    trend, sar, ep, af = 1.0, ep, h, accel
                elif lo < ep:
                    ep, af = lo, min(af + accel, limit)
            out[i] = sar
            h1, l1, h2, l2 = h, lo, h1, l1
        return {"psar": np.array(out)}, [trend, sar, ep, af, h1, l1, h2, l2]

    return step


def parabolic_sar(df: DataFrame, s: Series, accel: float = 0.02, limit: float = 0.2, indexed: bool = False) -> DataFrame:
    """Stop-and-reverse level; starts long at the first bar's low, null on the first row."""
    out = state_scan(df, s, ["high", "low"], _psar_step(accel, limit), ["psar"], indexed=indexed)
    return out.withColumn("psar", F.when(~F.isnan("psar"), F.col("psar")))


def _supertrend_step(cols, state):
    up, lo, close = cols["_upper"].tolist(), cols["_lower"].tolist(), cols["close"].tolist()
    n = len(close)
    line, direction = [float("nan")] * n, [float("nan")] * n
    for i in range(n):
        if up[i] != up[i]:
            continue
        if state is None or state[0] == 0.0:
            state = [1.0, up[i], lo[i], close[i]]
        else:
            trend, fu, fl, prev = state
            trend = 1.0 if close[i] > fu else -1.0 if close[i] < fl else trend
            fu = up[i] if up[i] < fu or prev > fu else fu
            fl = lo[i] if lo[i] > fl or prev < fl else fl
            state = [trend, fu, fl, close[i]]
        direction[i] = state[0]
        line[i] = state[2] if state[0] > 0 else state[1]
    return {"supertrend": np.array(line), "supertrend_direction": np.array(direction)}, state or [0.0] * 4


def supertrend(df: DataFrame, s: Series, n: int = 7, k: float = 3.0, indexed: bool = False) -> DataFrame:
    """Ratcheting bands around the bar middle at k Wilder ATRs; the line is the band on the trend's side."""
    from quotemill.operators.indicators import atr

    p = Panel(df, s, indexed=indexed)
    a = atr(p, n, "wilder", "_atr")
    mid = (F.col("high") + F.col("low")) / 2
    p.add("_upper", mid + k * F.col(a), [a])
    p.add("_lower", mid - k * F.col(a), [a])
    out = state_scan(p.done(keep_index=True), s, ["close", "_upper", "_lower"], _supertrend_step,
                     ["supertrend", "supertrend_direction"], indexed=True).drop("_upper", "_lower")
    return out.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("supertrend", "supertrend_direction")})


def affine_scan(df: DataFrame, s: Series, a: str, u: str, out: str, indexed: bool = False) -> DataFrame:
    """y = a y' + u with coefficients per row, y = 0 before the first row.

    A block folds to one pair (product of a, value from zero); the pairs form a shorter series of the same
    kind, scanned by the same function, and each block then replays from the value its predecessor ends with.
    """
    keys, b = list(s.keys), s.block_rows
    df = df if indexed else index_rows(df, s)
    rows = materialize(df.withColumn("_block", F.floor(F.col("_i") / b)), "affine-rows")
    by = [*keys, "_block"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ids = ", ".join(f"`{k}` {types[k]}" for k in by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        decay, value = 1.0, 0.0
        for x, y in zip(pdf[a].tolist(), pdf[u].tolist()):
            decay, value = decay * x, value * x + y
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "_a": [decay], "_u": [value]})

    folded = rows.select(*by, "_i", a, u).groupBy(*by).applyInPandas(fold, f"{ids}, _a double, _u double")
    folded = materialize(folded, "affine-blocks").withColumnRenamed("_block", "_i")
    blocks = folded.agg(F.max("_i")).first()[0] or 0
    if blocks >= b:
        ends = affine_scan(folded, s, "_a", "_u", "_y", indexed=True)
    else:
        def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i")
            y, ys = 0.0, []
            for x, v in zip(pdf["_a"].tolist(), pdf["_u"].tolist()):
                y = x * y + v
                ys.append(y)
            return pdf[[*keys, "_i"]].assign(_y=ys)

        ends = folded.groupBy(*keys).applyInPandas(ends_of, ids.replace("_block", "_i") + ", _y double")
    carry = ends.select(*keys, (F.col("_i") + 1).alias("_block"), F.col("_y").alias("_carry"))
    joined = rows.join(carry, by, "left")
    names = [f.name for f in rows.schema.fields if f.name != "_block"]
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + f", {out} double"

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        y = pdf["_carry"].iloc[0]
        y, ys = (0.0 if pd.isna(y) else float(y)), []
        for x, v in zip(pdf[a].tolist(), pdf[u].tolist()):
            y = x * y + v
            ys.append(y)
        return pdf[names].assign(**{out: ys})

    return joined.groupBy(*by).applyInPandas(replay, schema)
