"""Dataset versions, lineage graphs, operation history, retention."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.scalars import duration_seconds, has_all, has_any
from quotemill.operators.ordered import Series
from quotemill.operators.rolling import newest_per_key
from quotemill.session import materialize

c = F.col

VERSION = T.StructType(
    [
        T.StructField("version_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("operation", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("created_by", T.StringType()),
    ]
)


def table_checksum(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row hashes folded by xor and by sum, with the row count.

    A row's hash covers names, types and null flags besides the values, so a null cannot change places with a value.
    """
    kinds = dict(df.dtypes)
    cells = [x for n in sorted(df.columns) for x in (F.lit(f"{n}:{kinds[n]}"), c(f"`{n}`").isNull(), c(f"`{n}`"))]
    h = F.xxhash64(*cells)
    folded = df.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(2147483647))).alias("s"), F.count(F.lit(1)).alias("rows"))
    return folded.select(F.sha2(F.concat_ws("|", "x", "s", "rows"), 256).alias("checksum"), "rows")


def version_rows(df: DataFrame, dataset: str, operation: str, ts: str, parents: Sequence[str] = (), tags: Sequence[str] = (),
                 created_by: str = "system", metadata: dict[str, str] | None = None) -> DataFrame:
    """One version record for the current contents; the id derives from dataset and checksum."""
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return table_checksum(df).select(
        F.concat_ws("-", F.lit(dataset), F.substring("checksum", 1, 12)).alias("version_id"), F.lit(dataset).alias("dataset_id"),
        F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(operation).alias("operation"), "checksum", "rows", meta.alias("metadata"),
        texts(parents).alias("parents"), texts(tags).alias("tags"), F.lit(created_by).alias("created_by"))


def list_versions(versions: DataFrame, dataset: str | None = None, any_tag: Sequence[str] = (), all_tags: Sequence[str] = ()) -> DataFrame:
    out = versions
    if dataset is not None:
        out = out.filter(c("dataset_id") == dataset)
    if any_tag:
        out = out.filter(has_any("tags", any_tag))
    if all_tags:
        out = out.filter(has_all("tags", all_tags))
    return out.orderBy(F.desc("ts"), "version_id")


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None, backwards: bool = False) -> DataFrame:
    """Nodes reached from ``start`` (node) along (src, dst) edges, with the smallest depth.

    Breadth first: each level joins the frontier to the edges and drops nodes already seen, so cycles end and
    every node is kept once however many paths lead to it.  Without ``max_depth`` the walk ends when nothing is new.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    edges = edges.select(c(a).alias("node"), c(b).alias("next"))
    seen = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)), "lineage-seen")
    frontier = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.select("node").join(edges, "node").select(c("next").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "lineage-level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def lineage_report(upstream: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Quality, completeness, age and type counts of upstream entities, per depth."""
    j = upstream.join(entities, "node")
    age = F.timestamp_diff("HOUR", c("updated"), now)
    return j.groupBy("depth").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("kind").alias("kinds"), F.avg("quality").alias("mean_quality"),
        F.min("quality").alias("worst_quality"), F.avg(c("quality").isNotNull().cast("double")).alias("completeness"), F.min(age).alias("freshest_hours"))


def operation_history(operations: DataFrame, s: Series, n: int = 10) -> DataFrame:
    """Newest n operations per entity."""
    return newest_per_key(operations, s, n)


# -- retention -------------------------------------------------------------------------------------------


def expired(df: DataFrame, ts: str, keep: str, now: Column) -> Column:
    """Rows older than the keep duration; nothing expires under an unlimited policy."""
    seconds = duration_seconds(keep)
    if seconds is None:
        return F.lit(False)
    return c(ts) < now - F.make_dt_interval(secs=F.lit(float(seconds)))


def retain(df: DataFrame, ts: str, keep: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) rows by age."""
    gone = expired(df, ts, keep, now)
    return df.filter(~gone), df.filter(gone)


def retain_newest(df: DataFrame, s: Series, n: int) -> DataFrame:
    return newest_per_key(df, s, n).drop("rank")


def tier(ts: str, now: Column, bounds: Sequence[tuple[str, str]], last: str = "cold") -> Column:
    """Storage tier by age: the first (name, max age) that fits, else ``last``."""
    out = F.lit(last)
    for name, age in reversed(list(bounds)):
        out = F.when(c(ts) >= now - F.make_dt_interval(secs=F.lit(float(duration_seconds(age)))), name).otherwise(out)
    return out


def archive(spark: SparkSession, path: str, archive_path: str, condition: Column, run: str, part: str = "part") -> int:
    """Copy matching rows to the archive, then delete them from the table; returns the number moved.

    The copy replaces what the same ``run`` copied before: if a run fails between copy and deletion, running it again
    leaves every row in one place.
    """
    from quotemill.sources.store import delete_where

    spark.read.parquet(path).filter(condition).write.mode("overwrite").partitionBy(part).parquet(f"{archive_path}/run={run}")
    return delete_where(spark, path, condition, part)


# Retention actions by name: each takes the session, a partitioned table's path, the condition of the rows concerned and its own
# arguments, and returns how many rows it concerned.
ACTIONS: dict[str, Callable[..., int]] = {}


def register_action(name: str, run: Callable[..., int]) -> None:
    """Make an action available to policies; a name that is taken is replaced."""
    ACTIONS[name] = run


def _delete(spark: SparkSession, path: str, condition: Column, part: str = "part") -> int:
    from quotemill.sources.store import delete_where

    return delete_where(spark, path, condition, part)


def _blank(spark: SparkSession, path: str, condition: Column, columns: Sequence[str], part: str = "part") -> int:
    """Rows stay, the named columns are emptied; only partitions that hold such rows are rewritten."""
    df = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    touched = materialize(df.groupBy(part).agg(F.count_if(hit).alias("n")).filter("n > 0"), "blank-parts")
    rows = touched.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if rows:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        blanked = df.join(touched.select(part), part, "left_semi").withColumns({x: F.when(~hit, c(x)).otherwise(F.lit(None).cast(kinds[x])) for x in columns})
        materialize(blanked.select(df.columns), "blank-rows").hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return rows


def _archive(spark: SparkSession, path: str, condition: Column, archive_path: str, run: str, part: str = "part") -> int:
    return archive(spark, path, archive_path, condition, run, part)


register_action("delete", _delete)
register_action("archive", _archive)
register_action("blank", _blank)


def apply_policies(spark: SparkSession, path: str, policies: Sequence[tuple[str, str, dict]], now: Column, ts: str = "ts") -> list[tuple[str, str, int]]:
    """Run (action, keep, arguments) in turn on the rows older than ``keep``; returns action, keep and the rows concerned."""
    out = []
    for action, keep, args in policies:
        if action not in ACTIONS:
            raise ValueError(f"unknown retention action {action!r}")
        if duration_seconds(keep) is not None:
            out.append((action, keep, ACTIONS[action](spark, path, expired(spark.read.parquet(path), ts, keep, now), **args)))
        else:
            out.append((action, keep, 0))
    return out
