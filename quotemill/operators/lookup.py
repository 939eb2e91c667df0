"""Tick lookups: a small query builder, ranges, latest values, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TickQuery:
    """Collects filters, columns, grouping, order and paging, and emits one DataFrame."""

    def __init__(self, df: DataFrame, ts: str = "ts"):
        self._df, self._ts = df, ts
        self._select: list = []
        self._group: list[str] = []
        self._aggs: list[Column] = []
        self._order: list[Column] = []
        self._limit = self._offset = None

    def filter(self, condition: Column | str | None = None, **equals) -> TickQuery:
        if condition is not None:
            self._df = self._df.filter(condition)
        for name, value in equals.items():
            col = F.col(name)
            self._df = self._df.filter(col.isin(list(value)) if isinstance(value, (list, tuple, set)) else col == value)
        return self

    def time_range(self, start=None, end=None) -> TickQuery:
        if start is not None:
            self._df = self._df.filter(F.col(self._ts) >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            self._df = self._df.filter(F.col(self._ts) <= F.lit(end).cast("timestamp_ntz"))
        return self

    def select(self, *cols) -> TickQuery:
        self._select += cols
        return self

    def group_by(self, *cols: str, **aggs: Column) -> TickQuery:
        self._group += cols
        self._aggs += [a.alias(n) for n, a in aggs.items()]
        return self

    def order_by(self, *cols: str, desc: bool = False) -> TickQuery:
        self._order += [F.col(c).desc() if desc else F.col(c).asc() for c in cols]
        return self

    def limit(self, n: int) -> TickQuery:
        self._limit = n
        return self

    def offset(self, n: int) -> TickQuery:
        self._offset = n
        return self

    def build(self) -> DataFrame:
        df = self._df
        if self._group:
            df = df.groupBy(*self._group).agg(*self._aggs)
        if self._order:
            df = df.orderBy(*self._order)
        if self._offset:
            df = df.offset(self._offset)
        if self._limit is not None:
            df = df.limit(self._limit)
        return df.select(*self._select) if self._select else df


def get_ticks(t: DataFrame, symbol: str, exchange: str | None = None, start=None, end=None, skip: int = 0,
              limit: int = 100, price: tuple[float, float] | None = None) -> DataFrame:
    """Newest first, paged."""
    q = TickQuery(t).filter(symbol=symbol).time_range(start, end)
    if exchange is not None:
        q.filter(exchange=exchange)
    if price is not None:
        q.filter(F.col("price").between(*price))
    return q.order_by("ts", "tie", desc=True).offset(skip).limit(limit).build()


def by_id(t: DataFrame, tie) -> DataFrame:
    return t.filter(F.col("tie") == tie)


def latest_ticks(t: DataFrame, keys=("symbol", "exchange")) -> DataFrame:
    """Newest tick of each key by partial aggregation."""
    rest = [c for c in t.columns if c not in keys]
    best = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "tie")).alias("_r"))
    return best.select(*keys, "_r.*")


def newest(df: DataFrame, n: int, start=None, end=None, **equals) -> DataFrame:
    """The newest n snapshots or trades of a range; a bounded top-k."""
    return TickQuery(df).filter(**equals).time_range(start, end).order_by("ts", "tie", desc=True).limit(n).build()


def page(df: DataFrame, condition: Column, order: list[str], number: int, size: int) -> DataFrame:
    """Filter, then sort, then page (pages count from 1)."""
    return df.filter(condition).orderBy(*order).offset((number - 1) * size).limit(size)
