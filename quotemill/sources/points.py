"""Time-series points: a measurement, string tags, JSON-safe fields and a time; and questions about their schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_points(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], ts: str = "ts") -> DataFrame:
    """Tags become a string map; scalar fields stay, array / map / struct fields become ``<name>_json``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    complex_ = (T.ArrayType, T.MapType, T.StructType)
    parts = []
    for f in fields:
        if isinstance(kinds[f], complex_):
            parts.append(F.to_json(F.col(f)).alias(f"{f}_json"))
        else:
            parts.append(F.col(f))
    tag_map = F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[F.col(t).cast("string") for t in tags]))
    return df.select(F.lit(measurement).alias("measurement"), tag_map.alias("tags"), F.struct(*parts).alias("fields"),
                     F.col(ts).alias("time"))


def measurements(points: DataFrame) -> DataFrame:
    return points.groupBy("measurement").agg(F.count(F.lit(1)).alias("points"), F.min("time").alias("first_time"),
                                             F.max("time").alias("last_time"))


def field_keys(points: DataFrame) -> DataFrame:
    """Field names and types, read from the schema."""
    fields = points.schema["fields"].dataType.fields
    rows = [(f.name, f.dataType.simpleString()) for f in fields]
    return points.select("measurement").distinct().withColumn(
        "f", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(t).alias("type")) for n, t in rows]))
    ).select("measurement", "f.*")


def tag_keys(points: DataFrame) -> DataFrame:
    return points.select("measurement", F.explode(F.map_keys("tags")).alias("tag")).distinct()


def tag_values(points: DataFrame, tag: str) -> DataFrame:
    return points.select(F.element_at("tags", tag).alias("value")).filter("value IS NOT NULL").distinct()


def series_cardinality(points: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct (measurement, tags) combinations."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))
    if approximate:
        return points.groupBy("measurement").agg(F.approx_count_distinct(key).alias("series"))
    return points.select("measurement", key.alias("k")).distinct().groupBy("measurement").agg(F.count(F.lit(1)).alias("series"))


def statistics(points: DataFrame) -> DataFrame:
    """Points, series and days of history per measurement."""
    days = F.date_diff(F.max("time"), F.min("time")).cast("long") + 1
    base = points.groupBy("measurement").agg(F.count(F.lit(1)).alias("points"), days.alias("days"))
    return base.join(series_cardinality(points), "measurement")


def retention_report(points: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Per measurement its policy, the points and those past it; ``policies`` has measurement and ``keep_seconds`` (null: for ever).

    A measurement without policy keeps everything.
    """
    kept = points.join(policies, "measurement", "left")
    past = F.coalesce(F.col("time") < now - F.make_dt_interval(secs=F.col("keep_seconds").cast("double")), F.lit(False))
    return kept.groupBy("measurement", "keep_seconds").agg(F.count(F.lit(1)).alias("points"), F.count_if(past).alias("expired"), F.min(F.when(~past, F.col("time"))).alias("oldest_kept"))
