"""Order-dependent work that stays parallel when one key holds most of the rows.

Every ordered operator goes through three steps:

1. ``index_rows`` gives each row its position inside its key.  The time axis is cut at approximate
   quantiles, so no (key, slice) group is larger than a slice of the whole table; slice counts are
   prefix-summed (a table of keys x slices) and added to a row number local to the slice.
2. ``Panel`` cuts each key into blocks of ``block_rows`` rows and copies only the rows a neighbour block
   looks back (or ahead) to, then evaluates ordinary window expressions per (key, block).
3. ``cumulative`` handles frames without a lower bound: a running value inside each block plus the carry
   of the earlier blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import materialize

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz column, independent of the session time zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col)


@dataclass(frozen=True)
class Series:
    """Which columns identify a series and put its rows in a total order."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    tie: tuple[str, ...] = ("tie",)
    block_rows: int = 16384
    slices: int | None = None

    def order(self) -> list[Column]:
        return [F.col(self.ts), *[F.col(c) for c in self.tie]]

    def with_(self, **kw) -> Series:
        return replace(self, **kw)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row."""
    one = F.broadcast(one_row.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def slice_count(df: DataFrame, wanted: int | None = None) -> int:
    if wanted:
        return wanted
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, cols: Sequence[str], slices: int) -> dict[str, list[float]]:
    """Quantile cut points per numeric column; the result is bounded by ``slices`` values a column."""
    probs = [i / slices for i in range(1, slices)]
    found = df.approxQuantile(list(cols), probs, 1.0 / (2 * slices))
    out = {}
    for name, qs in zip(cols, found):
        inner = sorted({float(q) for q in qs if q is not None and not math.isnan(q)})
        out[name] = [-math.inf, *(inner or [0.0]), math.inf]
    return out


def slice_by(df: DataFrame, col: str, out: str, slices: int) -> DataFrame:
    """Number the quantile slice of a numeric column (monotone in the column)."""
    points = cut_points(df.select(col), [col], slices)[col]
    cut = Bucketizer(splits=points, inputCol=col, outputCol=out, handleInvalid="keep")
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def index_rows(df: DataFrame, s: Series, out: str = "_i", start: str | None = None) -> DataFrame:
    """Add the 0-based position of each row within its key, in (ts, tie) order; ``start`` names a column for the position of
    the first row of the same time."""
    keys = list(s.keys)
    df = df.withColumn("_at", epoch_us(s.ts).cast("double"))
    df = slice_by(df, "_at", "_slice", slice_count(df, s.slices)).drop("_at")
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*s.order())
    df = df.join(offsets, [*keys, "_slice"]).withColumn(out, F.col("_before") + F.row_number().over(local) - 1)
    if start:  # rows of one time share a slice; the order of ``local`` serves here, too
        df = df.withColumn(start, F.col("_before") + F.rank().over(Window.partitionBy(*keys, "_slice").orderBy(s.ts)) - 1)
    return df.drop("_slice", "_before")


# Rows of a panel block when nothing looks back far.
PANEL_ROWS = 4096

# Weight of history below which it cannot change a double any more.
FORGET = 1e-17


# Largest power of 1 / decay that a stretch may reach inside a double.
LARGEST = 1e250


def memory_rows(decay: float) -> int:
    """Power-of-four window after which ``decay`` raised to its length is below rounding error.

    The common length is 256; a fast decay gets a shorter one, so that the inverse powers inside a stretch stay finite.
    History below ``FORGET`` of the total is dropped: a spike more than 1e16 times the level would show that.
    """
    need = math.ceil(math.log(FORGET) / math.log(decay))
    m = 256
    while m < need:
        m *= 4
    while m > 16 and m // 4 >= need and m * -math.log(decay) > math.log(LARGEST):
        m //= 4
    return m


@dataclass
class _Step:
    out: str
    col: Column
    depth: int


@dataclass
class Panel:
    """Window expressions over one ordered series, evaluated per (key, block).

    Each method adds a column and tracks how far back (``reach``) and ahead (``ahead``) it depends on other
    rows; ``done`` copies exactly that many rows into the neighbour blocks, so results do not depend on
    the block size.  Columns of the same dependency depth share one projection.
    """

    df: DataFrame
    series: Series = field(default_factory=Series)
    indexed: bool = False

    def __post_init__(self) -> None:
        self.steps: list[_Step] = []
        self.reach: dict[str, int] = {}
        self.ahead: dict[str, int] = {}
        self.depth: dict[str, int] = {}
        self.hidden: list[str] = []
        self.minis: set[int] = set()
        self.weights: dict[tuple, str] = {}
        self.w = Window.partitionBy(*self.series.keys, "_block").orderBy("_i")
        self.keys_sql = ", ".join(f"`{k}`" for k in self.series.keys)
        self.order_sql = f"PARTITION BY {self.keys_sql}, _block ORDER BY _i"

    # -- bookkeeping ---------------------------------------------------------------------------------
    def add(self, out: str, col: Column, uses: Sequence[str] = (), back: int = 0, fwd: int = 0) -> str:
        if out in self.depth:
            return out
        self.depth[out] = 1 + max((self.depth.get(u, 0) for u in uses), default=0)
        self.reach[out] = back + max((self.reach.get(u, 0) for u in uses), default=0)
        self.ahead[out] = fwd + max((self.ahead.get(u, 0) for u in uses), default=0)
        self.steps.append(_Step(out, col, self.depth[out]))
        return out

    def hide(self, *names: str) -> None:
        self.hidden += [n for n in names if n not in self.hidden]

    def temp(self, out: str, col: Column, uses: Sequence[str] = (), back: int = 0, fwd: int = 0) -> str:
        if out not in self.depth:
            self.hide(out)
        return self.add(out, col, uses, back, fwd)

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def over(self, agg: str, n: int) -> str:
        """SQL text of an aggregate over the last n rows."""
        return f"{agg} OVER ({self.order_sql} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    # -- window functions ----------------------------------------------------------------------------
    # Written as SQL text: one parse is cheaper to build than a chain of column calls, and bundles have hundreds.
    def lag(self, out: str, c: str, k: int = 1) -> str:
        return self.add(out, F.expr(f"lag(`{c}`, {k}) OVER ({self.order_sql})"), [c], back=k)

    def lead(self, out: str, c: str, k: int = 1) -> str:
        return self.add(out, F.expr(f"lead(`{c}`, {k}) OVER ({self.order_sql})"), [c], fwd=k)

    def roll(self, out: str, agg: str, c: str, n: int, min_periods: int | None = None) -> str:
        """Any SQL aggregate of ``{}`` over the last n rows, null until the window holds enough non-null values."""
        if out in self.depth:
            return out
        need = n if min_periods is None else min_periods
        value = self.over(agg.format(f"`{c}`"), n)
        return self.add(out, F.expr(f"CASE WHEN {self.over(f'count(`{c}`)', n)} >= {need} THEN {value} END"), [c], back=n - 1)

    def mean(self, out: str, c: str, n: int, min_periods: int | None = None) -> str:
        return self.roll(out, "avg({})", c, n, min_periods)

    def total(self, out: str, c: str, n: int, min_periods: int | None = None) -> str:
        return self.roll(out, "sum({})", c, n, min_periods)

    def std(self, out: str, c: str, n: int, ddof: int = 1, min_periods: int | None = None) -> str:
        return self.roll(out, "stddev_samp({})" if ddof else "stddev_pop({})", c, n, min_periods)

    def low(self, out: str, c: str, n: int, min_periods: int | None = None) -> str:
        return self.roll(out, "min({})", c, n, min_periods)

    def high(self, out: str, c: str, n: int, min_periods: int | None = None) -> str:
        return self.roll(out, "max({})", c, n, min_periods)

    # -- linear recurrences --------------------------------------------------------------------------
    def recur(self, out: str, u: str, decay: float, start: int = 0) -> str:
        """y = decay * y' + u, the first value at row ``start``; u must be 0 before and not null.

        Rows are cut into stretches long enough for a stretch to forget what came before the previous one.
        Inside a stretch y is a running sum of u / decay^j scaled back; the previous stretch adds one term.
        """
        if out in self.depth:
            return out
        m = memory_rows(decay)
        self.minis.add(m)
        j, d, part = f"_j{m}", f"{decay!r}D", f"_z_{out}"
        inner = f"PARTITION BY {self.keys_sql}, _block, _m{m} ORDER BY _i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        self.temp(part, F.expr(f"pow({d}, {j}) * sum(`{u}` * pow({d}, -{j})) OVER ({inner})"), [u], back=m)
        before = f"{self.order_sql} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        tail = f"last(CASE WHEN {j} = {m - 1} THEN `{part}` END, true) OVER ({before})"
        y = f"CASE WHEN _i >= {start} THEN `{part}` + coalesce({tail} * pow({d}, {j} + 1), 0D) END"
        return self.add(out, F.expr(y), [part], back=m)

    def ema(self, out: str, c: str, span: float | None = None, alpha: float | None = None, start: int = 0,
            seed: str | None = None, whole: bool = False) -> str:
        """Recursive moving average, seeded with the first value (or ``seed``) at row ``start``.

        A null value has no weight while the weights of earlier values go on fading by row, as in an exponentially
        weighted mean by absolute positions; the result stays as it was.  Without nulls the weights sum to 1 and this is
        y = y' + alpha (x - y').  Alpha 1 (span 1) is the value itself.
        ``whole`` says that the values hold no null, which saves the sum of weights.
        """
        if out in self.depth:
            return out
        a = alpha if alpha is not None else 2.0 / (span + 1.0)
        first, uses = seed or c, [c] + ([seed] if seed else [])
        if a >= 1.0:
            return self.add(out, F.expr(f"CASE WHEN _i = {start} THEN `{first}` WHEN _i > {start} THEN `{c}` END"), uses)
        u = f"CASE WHEN _i < {start} THEN 0D WHEN _i = {start} THEN coalesce(`{first}`, 0D) ELSE {a!r}D * coalesce(`{c}`, 0D) END"
        self.temp(f"_u_{out}", F.expr(u), uses)
        if whole:
            return self.recur(out, f"_u_{out}", 1.0 - a, start)
        total = self.recur(f"_n_{out}", f"_u_{out}", 1.0 - a, start)
        key = (c, seed, a, start)
        if key not in self.weights:
            name = self.weights[key] = f"_w{len(self.weights)}"
            w = f"CASE WHEN _i < {start} THEN 0D WHEN _i = {start} THEN nvl2(`{first}`, 1D, 0D) ELSE nvl2(`{c}`, {a!r}D, 0D) END"
            self.temp(f"_u{name}", F.expr(w), uses)
            self.recur(name, f"_u{name}", 1.0 - a, start)
        self.hide(total, self.weights[key])
        return self.add(out, F.expr(f"try_divide(`{total}`, `{self.weights[key]}`)"), [total, self.weights[key]])

    def wilder(self, out: str, c: str, n: int, start: int, whole: bool = False) -> str:
        """Average with alpha = 1/n whose seed is the plain mean of the n values ending at ``start``."""
        seed = self.mean(f"_seed_{out}", c, n)
        self.hide(seed)
        return self.ema(out, c, alpha=1.0 / n, start=start, seed=seed, whole=whole)

    # -- evaluation ----------------------------------------------------------------------------------
    def block_size(self) -> int:
        """Small blocks for parallelism, but at least four times what a block copies from its neighbours."""
        copied = max(self.reach.values(), default=0) + max(self.ahead.values(), default=0)
        return max(min(self.series.block_rows, PANEL_ROWS), 4 * copied)

    def blocks(self) -> DataFrame:
        back = max(self.reach.values(), default=0)
        fwd = max(self.ahead.values(), default=0)
        b = self.block_size()
        df = self.df if self.indexed else index_rows(self.df, self.series)
        i = F.col("_i")
        first = F.floor(F.greatest(i - fwd, F.lit(0)) / b)
        df = df.withColumn("_block", F.explode(F.sequence(first, F.floor((i + back) / b))))
        for m in self.minis:
            df = df.withColumns({f"_m{m}": F.floor(i / m), f"_j{m}": (i % m).cast("double")})
        return df

    def done(self, keep_index: bool = False) -> DataFrame:
        df = self.blocks()
        for level in sorted({s.depth for s in self.steps}):
            df = df.withColumns({s.out: s.col for s in self.steps if s.depth == level})
        df = df.filter(F.col("_block") == F.floor(F.col("_i") / self.block_size()))
        extra = [f"_{k}{m}" for m in self.minis for k in "mj"]
        drop = self.hidden + extra + ["_block"] + ([] if keep_index else ["_i"])
        return df.drop(*drop)


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def cumulative(df: DataFrame, s: Series, cols: dict[str, tuple[str, str]], indexed: bool = False) -> DataFrame:
    """Running values from the first row of each key: ``{out: (kind, column)}``.

    Kinds: sum, max, min, last (latest non-null so far), next (nearest non-null from here on).
    """
    keys, b = list(s.keys), s.block_rows
    df = (df if indexed else index_rows(df, s)).withColumn("_block", F.floor(F.col("_i") / b))
    here = Window.partitionBy(*keys, "_block").orderBy("_i")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Frames open towards the end cost a pass per row, so looking ahead is looking back in reverse order.
    onward = Window.partitionBy(*keys, "_block").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    local, totals, carries, final = {}, [], [], {}
    for out, (kind, c) in cols.items():
        col, tot, inn, car = F.col(c), f"_t_{out}", f"_l_{out}", f"_c_{out}"
        if kind in _FOLD:
            fold = _FOLD[kind]
            local[inn] = fold(col).over(upto)
            totals.append(fold(col).alias(tot))
            carries.append(fold(tot).over(earlier).alias(car))
            if kind == "sum":
                final[out] = F.when(F.col(inn).isNotNull() | F.col(car).isNotNull(),
                                    F.coalesce(F.col(inn), F.lit(0)) + F.coalesce(F.col(car), F.lit(0)))
            else:
                final[out] = (F.greatest if kind == "max" else F.least)(F.col(inn), F.col(car))
        elif kind == "last":
            local[inn] = F.last(col, ignorenulls=True).over(upto)
            totals.append(F.max_by(col, F.when(col.isNotNull(), F.col("_i"))).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(earlier).alias(car))
            final[out] = F.coalesce(F.col(inn), F.col(car))
        elif kind == "next":
            local[inn] = F.last(col, ignorenulls=True).over(onward)
            totals.append(F.min_by(col, F.when(col.isNotNull(), F.col("_i"))).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(later).alias(car))
            final[out] = F.coalesce(F.col(inn), F.col(car))
        else:
            raise ValueError(f"unknown running value {kind!r}")
    carried = df.groupBy(*keys, "_block").agg(*totals).select(*keys, "_block", *carries)
    out = df.withColumns(local).join(carried, [*keys, "_block"]).withColumns(final)
    return out.drop("_block", *local, *[f"_c_{o}" for o in cols], *([] if indexed else ["_i"]))


def islands(df: DataFrame, s: Series, starts: Column, out: str = "island") -> DataFrame:
    """Number consecutive stretches; ``starts`` is true on the first row of a stretch (may use ``_prev_ts``)."""
    p = Panel(df, s)
    p.lag("_prev_ts", s.ts)
    p.add("_start", F.when(starts, 1).otherwise(0), ["_prev_ts"])
    flagged = p.done(keep_index=True)
    return cumulative(flagged, s, {out: ("sum", "_start")}, indexed=True).drop("_start", "_prev_ts", "_i")


def running_totals(df: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (),
                   slices: int | None = None) -> DataFrame:
    """Cumulative sums (``cum_<c>``) in ``value`` order for a table that is unique in (keys, value).

    Also returns ``next_value``, the following value of the same key.  Slices of the value range are summed
    first, so no task sees more than one slice of a key.
    """
    keys = list(keys)
    df = slice_by(df, value, "_slice", slice_count(df, slices))
    by_slice = df.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums], F.min(value).alias("_lo"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        F.lead("_lo").over(order).alias("_next_lo"),
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(value)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(offsets, [*keys, "_slice"])
    out = out.withColumns(
        {
            **{f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(upto) for c in sums},
            "next_value": F.coalesce(F.lead(value).over(local), F.col("_next_lo")),
        }
    )
    return out.drop("_slice", "_next_lo", *[f"_o_{c}" for c in sums])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
              names: Sequence[str] | None = None, count: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without collecting a group in one place.

    Equal values are counted first; running counts locate the two order statistics of each quantile.  ``count`` names a column
    that says how many rows a row stands for.
    """
    keys = list(keys)
    names = list(names or [f"p{round(p * 100):02d}" for p in probs])
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
    counts = materialize(counted.agg((F.sum(count) if count else F.count(F.lit(1))).alias("n")), "value-counts")  # read for cuts, slices, sizes and ranks
    ranked = running_totals(counts, "_v", ["n"], keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    ranked = ranked.join(sizes, keys) if keys else attach(ranked, sizes)
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("_size") - 1) * F.lit(float(p))
        def at(rank):
            return F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), F.col("_v")))
        lo, hi, frac = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
