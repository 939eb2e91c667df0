"""Tables of files: formats, partition layouts, upsert, range delete, export and import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.scalars import hash_bucket, matches, time_key
from quotemill.session import materialize, remove_path

# File suffix -> data source name.
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def format_of(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}")
    return FORMATS[suffix]


def _options(fmt: str) -> dict[str, str]:
    return CSV if fmt == "csv" else {"timestampNTZFormat": CSV["timestampNTZFormat"]} if fmt == "json" else {}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt).options(**_options(fmt))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).options(**_options(fmt))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def export_table(df: DataFrame, path: str, conditions: Mapping[str, object] | None = None, fmt: str | None = None) -> None:
    fmt = fmt or format_of(path)
    out = df.filter(matches(conditions)) if conditions else df
    out.write.format(fmt).options(**_options(fmt)).save(path)


# -- partition layouts -----------------------------------------------------------------------------------


def layout(kind: str, ts: str = "ts", symbol: str = "symbol", unit: str = "day", buckets: int = 16,
           parts: Sequence[str] = ("time", "symbol")) -> Column:
    """Partition key of a row: by time unit, symbol, stable hash, or several joined with '/'."""
    if kind == "time":
        return time_key(ts, unit)
    if kind == "symbol":
        return F.col(symbol)
    if kind == "hash":
        return hash_bucket(buckets, symbol).cast("string")
    if kind == "composite":
        return F.concat_ws("|", *[layout(k, ts, symbol, unit, buckets) for k in parts])
    raise ValueError(f"unknown layout {kind!r}")


def partition_tags(ts: str = "ts", asset: str = "symbol") -> dict[str, Column]:
    """Internal partition columns: day, hour, ISO week and asset."""
    return {"__day": time_key(ts, "day"), "__hour": F.format_string("%02d", F.hour(ts)), "__week": time_key(ts, "week"),
            "__asset": F.col(asset)}


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def write_partitioned(df: DataFrame, path: str, key: Column, name: str = "part", mode: str = "append",
                      files_per_key: int = 1, spread: Sequence[str] = ("symbol", "ts")) -> None:
    """One folder per key; a large key is spread over ``files_per_key`` tasks, rows sorted inside each file."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(files_per_key))
    keyed = df.withColumn(name, key).withColumn("_salt", salt)
    keyed = keyed.repartition(name, "_salt").sortWithinPartitions(name, *spread).drop("_salt")
    writer = keyed.write.mode(mode).partitionBy(name)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def scan_partitions(spark: SparkSession, path: str, schema: T.StructType | None = None, **equals) -> DataFrame:
    """Equality filters on partition and data columns; the first prune folders, the rest push to the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).filter(matches(equals))


# -- change in place -------------------------------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ingest order; a partial aggregate, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def merge_rows(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Base rows whose key is not updated, plus the latest update of each key."""
    new = latest_per_key(updates, keys, order)
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def new_keys_only(updates: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    return updates.join(base.select(*keys), list(keys), "left_anti")


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str],
           part: str = "part") -> None:
    """Upsert into a partitioned table, rewriting only the partitions that receive updates."""
    updates = materialize(updates, "upsert-in")
    touched = updates.select(part).distinct()
    base = spark.read.schema(updates.schema).parquet(path).join(touched, part, "left_semi")
    merged = materialize(merge_rows(base, updates, keys, order), "upsert-out")
    merged.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def delete_where(spark: SparkSession, path: str, condition: Column, part: str = "part") -> int:
    """Delete matching rows; only partitions that hold one are rewritten.  Returns the number of rows removed."""
    df = spark.read.parquet(path)
    gone = F.coalesce(condition, F.lit(False))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    counts = df.groupBy(part, folder.alias("folder")).agg(F.count_if(gone).alias("n"), F.count_if(~gone).alias("left"))
    hit = materialize(counts.filter("n > 0"), "delete-hit")
    removed = hit.agg(F.sum("n")).first()[0] or 0
    if removed:
        touched = hit.filter("left > 0").select(part).distinct()
        keep = materialize(df.join(touched, part, "left_semi").filter(~gone), "delete-keep")
        keep.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        for r in hit.filter("left = 0").select("folder").toLocalIterator():  # as many as folders were emptied
            # File paths are percent-encoded URIs; a path made from the URI keeps file system and host, and is decoded once.
            remove_path(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"])).toString())
    return removed


def range_predicate(ts: str, start, stop, extra: Column | None = None) -> Column:
    """[start, stop) with an optional further condition."""
    cond = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz"))
    return cond if extra is None else cond & extra


def compact(pages: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Concatenate pages of bars, drop repeats, sort inside partitions."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out.dropDuplicates(list(keys)).sortWithinPartitions(*keys)
