"""Table schemas and the bar-interval catalogue."""

from pyspark.sql import types as T

PRICE_LEVEL = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())])

TICK = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

STREAM_TICK = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("conditions", T.ArrayType(T.StringType())),
    ]
)

QUOTE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid_size", T.DoubleType()),
        T.StructField("ask_size", T.DoubleType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("data_type", T.StringType()),
    ]
)

TRADE = T.StructType(
    [
        T.StructField("trade_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("side", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("taker_side", T.StringType()),
        T.StructField("trade_condition", T.StringType()),
        T.StructField("is_snapshot", T.BooleanType()),
    ]
)

BOOK = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("bids", T.ArrayType(PRICE_LEVEL)),
        T.StructField("asks", T.ArrayType(PRICE_LEVEL)),
    ]
)

CANDLE = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("symbol", T.StringType()),
    ]
    + [T.StructField(c, T.DecimalType(38, 18)) for c in ("open", "high", "low", "close", "volume")]
)

FEATURE_VALUE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Bar interval names and their Spark durations (weeks and months go by calendar).
INTERVALS = {
    "1m": "1 minute",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "30m": "30 minutes",
    "1h": "1 hour",
    "4h": "4 hours",
    "1d": "1 day",
    "1w": "week",
    "1M": "month",
}
