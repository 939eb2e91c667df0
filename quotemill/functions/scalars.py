"""Column helpers: time keys, durations, JSON, hashes, predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Duration unit names and their lengths in seconds (months are 30 days).
UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}

# date_format patterns of the time partition keys.
TIME_KEYS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "minute": "yyyy-MM-dd-HH-mm"}


def duration_seconds(text: str) -> float | None:
    """``1h30m`` -> 5400; ``INF`` (keep for ever) -> None."""
    if text.upper() == "INF":
        return None
    parts = re.findall(r"(\d+)(ms|[smhdwM])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNIT_SECONDS[u] for n, u in parts)


def interval(text: str) -> Column:
    secs = duration_seconds(text)
    if secs is None:
        raise ValueError("an unlimited duration has no interval")
    return F.make_dt_interval(secs=F.lit(float(secs)))


def ieee_quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: over 0 infinite or, of 0, NaN; null only where a or b is null."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_log(x: Column) -> Column:
    """ln(x) as floating-point arithmetic has it: -infinite at 0, NaN below; null only where x is null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def time_key(ts: str | Column, unit: str) -> Column:
    """Partition key of a timestamp: day, hour, minute, or ISO week."""
    col = F.col(ts) if isinstance(ts, str) else ts
    if unit == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), col), F.weekofyear(col))
    return F.date_format(col, TIME_KEYS[unit])


def uniform_draw(seed: int, *cols: Column | str) -> Column:
    """A number in (0, 1) that seed and columns alone decide: 52 bits of an MD5, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hash_bucket(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def parse_time(col: str) -> Column:
    """ISO text, or epoch seconds / milliseconds / microseconds told apart by magnitude, to a UTC timestamp_ntz."""
    text = F.col(col).cast("string")
    number = text.try_cast("double")
    size = F.abs(number)
    micros = F.when(size < 1e11, number * 1e6).when(size < 1e14, number * 1e3).otherwise(number)
    at = F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.when(number.isNotNull(), at).otherwise(F.try_to_timestamp(text).cast("timestamp_ntz"))


def normalize_symbol(col: str | Column) -> Column:
    """``BTC-USD`` -> ``BTC/USD``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.upper(c), F.lit("-"), F.lit("/"))


def record_checksum(df: DataFrame, cols: Sequence[str] | None = None, algorithm: str = "sha256") -> Column:
    """Digest of a record with its fields in name order."""
    names = sorted(cols or df.columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def wildcard(col: str, pattern: str) -> Column:
    """``*`` and ``?`` wildcards, the rest literal, ignoring case."""
    escaped = re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%").replace("?", "_")
    return F.col(col).ilike(escaped)


def contains_text(col: str, text: str) -> Column:
    return F.lower(F.col(col)).contains(text.lower())


def matches(conditions: Mapping[str, object]) -> Column:
    """Conjunction from a mapping: value (=), list (IN), None (IS NULL), (low, high) tuple (inclusive range)."""
    out = F.lit(True)
    for name, want in conditions.items():
        col = F.col(name)
        if want is None:
            out = out & col.isNull()
        elif isinstance(want, tuple):
            low, high = want
            if low is not None:
                out = out & (col >= F.lit(low))
            if high is not None:
                out = out & (col <= F.lit(high))
        elif isinstance(want, (list, set)):
            out = out & col.isin(list(want))
        else:
            out = out & (col == F.lit(want))
    return out


def has_any(tags: str, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(tags), F.array(*[F.lit(w) for w in wanted]))


def has_all(tags: str, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col(tags))) == 0


def message(template: str, **cols: str | Column) -> Column:
    """Fill ``{name}`` holes of a template with columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        F.lit(x) if k % 2 == 0 else F.coalesce(F.col(cols.get(x, x)).cast("string") if isinstance(cols.get(x, x), str)
                                              else cols[x].cast("string"), F.lit(""))
        for k, x in enumerate(parts)
    ])


def tick_align(price: str | Column, tick: float) -> Column:
    c = F.col(price) if isinstance(price, str) else price
    return F.round(c / tick) * tick


def clip(col: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(col), F.lit(low)), F.lit(high))


def clean_number(col: str) -> Column:
    """Null, NaN and infinities become 0."""
    c = F.col(col)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def calendar(ts: str) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0) and month."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)}
