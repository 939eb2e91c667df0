"""Payload decoding for message streams; the same expressions serve batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.schemas import QUOTE, STREAM_TICK

CORRUPT = "_corrupt_record"


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", keep_errors: bool = False) -> DataFrame:
    """JSON text to columns.  Missing fields are null; unreadable rows are dropped, or kept with their text."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value).cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in df.columns if c != value]
    out = df.withColumn("_p", parsed).select(*rest, "_p.*")
    if keep_errors:
        return out
    return out.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def decode_ticks(df: DataFrame, value: str = "value") -> DataFrame:
    return decode_json(df, STREAM_TICK, value)


def normalize_quotes(df: DataFrame, value: str = "value") -> DataFrame:
    """Quotes need symbol, bid and ask; sizes default to 0 and the exchange to 'unknown'."""
    q = decode_json(df, QUOTE, value).filter("symbol IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL")
    return q.withColumns(
        {
            "bid_size": F.coalesce("bid_size", F.lit(0.0)),
            "ask_size": F.coalesce("ask_size", F.lit(0.0)),
            "exchange": F.coalesce("exchange", F.lit("unknown")),
        }
    )


def decode_raw(payload: str | Column) -> Column:
    """Bytes to JSON text: valid JSON as it is, other text as ``{"raw": text}``, non-UTF-8 as its hex."""
    c = F.col(payload) if isinstance(payload, str) else payload
    text = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    fallback = F.to_json(F.struct(F.coalesce(text, F.lower(F.hex(c))).alias("raw")))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(fallback)


def message_metadata() -> Column:
    """Topic, partition, offset and time of a broker message as one struct."""
    return F.struct("topic", "partition", "offset", F.col("timestamp").alias("message_time"))


def encode_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """All columns as one JSON value, with an optional message key."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)
