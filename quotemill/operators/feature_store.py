"""A feature store on files: values partitioned by feature and version, metadata as an append-only log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.scalars import contains_text, has_all, wildcard
from quotemill.operators.joins import asof_join, assemble_features
from quotemill.operators.ordered import Series, quantiles
from quotemill.operators.stats import sample_kurtosis, sample_skew
from quotemill.schemas import FEATURE_VALUE
from quotemill.session import path_exists, remove_path
from quotemill.sources.store import latest_per_key

c = F.col

METADATA = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- metadata ----------------------------------------------------------------------------------------
    def register(self, feature: str, version: int, description: str = "", value_type: str = "double",
                 tags: Sequence[str] = (), status: str = "draft", seq: int | None = None) -> None:
        """Append one metadata record; the record with the highest seq of a (feature, version) counts.

        Without ``seq`` the record comes after all that the log holds.
        """
        self.register_all([(feature, version, status, description, value_type, list(tags), self.next_seq() if seq is None else seq)])

    def next_seq(self) -> int:
        """One more than the highest sequence number of the log."""
        if not path_exists(self.spark, f"{self.root}/metadata"):
            return 0
        last = self.spark.read.schema(METADATA).parquet(f"{self.root}/metadata").agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    def register_all(self, records: Sequence[tuple]) -> None:
        """Append many records in one write; fields as in ``METADATA``."""
        self.spark.createDataFrame(list(records), METADATA).coalesce(1).write.mode("append").parquet(f"{self.root}/metadata")

    def metadata(self) -> DataFrame:
        log = self.spark.read.schema(METADATA).parquet(f"{self.root}/metadata")
        return latest_per_key(log, ["feature", "version"], ["seq"]).filter("status != 'deleted'")

    def promote(self, feature: str, version: int, status: str = "production", seq: int | None = None) -> None:
        found = self.metadata().filter((c("feature") == feature) & (c("version") == version)).first()
        if found is None:
            raise KeyError(f"{feature} version {version}")
        self.register(feature, version, found["description"], found["value_type"], found["tags"], status, seq)

    def resolve(self, production: bool = False) -> DataFrame:
        """Latest (or latest production) version of every feature."""
        m = self.metadata()
        if production:
            m = m.filter("status = 'production'")
        return m.groupBy("feature").agg(F.max("version").alias("version"))

    def search(self, text: str | None = None, name: str | None = None, tags: Sequence[str] = (), page: int = 1, size: int = 20) -> DataFrame:
        """Filter, sort by name and version, then page."""
        m = self.metadata()
        if text:
            m = m.filter(contains_text("description", text) | contains_text("feature", text))
        if name:
            m = m.filter(wildcard("feature", name))
        if tags:
            m = m.filter(has_all("tags", tags))
        return m.orderBy("feature", "version").offset((page - 1) * size).limit(size)

    # -- values ------------------------------------------------------------------------------------------
    def write(self, values: DataFrame, batch: str | int | None = None) -> None:
        """Add (feature, version, entity_id, ts, value).

        Rows are gathered by feature and version; adaptive execution splits large ones and merges small ones.  With
        ``batch`` the rows replace those written under the same batch before, so a replayed batch counts once.
        """
        rows = values.select(*[c(f.name).cast(f.dataType) for f in FEATURE_VALUE.fields])
        rows = rows.hint("rebalance", "feature", "version").withColumn("batch", F.lit("none" if batch is None else str(batch)))
        mode = rows.write.mode("append" if batch is None else "overwrite").option("partitionOverwriteMode", "dynamic")
        mode.partitionBy("feature", "version", "batch").parquet(f"{self.root}/values")

    def _values(self) -> DataFrame:
        return self.spark.read.schema(FEATURE_VALUE).parquet(f"{self.root}/values").drop("batch")

    def read(self, features: Sequence[str], entities: Sequence[str] | None = None, start=None, end=None, limit: int | None = None,
             version: int | None = None) -> DataFrame:
        """Values of features, optionally for some entities and a time range; newest first when limited."""
        v = self._values().filter(c("feature").isin(list(features)))
        if version is not None:
            v = v.filter(c("version") == version)
        if entities is not None:
            v = v.filter(c("entity_id").isin(list(entities)))
        if start is not None:
            v = v.filter(c("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            v = v.filter(c("ts") <= F.lit(end).cast("timestamp_ntz"))
        return v if limit is None else v.orderBy(F.desc("ts"), "feature", "entity_id").limit(limit)

    def read_set(self, features: Sequence[str], production: bool = False, **kw) -> DataFrame:
        """Wide rows (entity_id, ts, one column per feature) at each feature's resolved version."""
        chosen = self.resolve(production).filter(c("feature").isin(list(features)))
        return assemble_features(self.read(features, **kw).join(F.broadcast(chosen), ["feature", "version"], "left_semi"), features)

    def lookup(self, requests: DataFrame, features: Sequence[str], block_rows: int = 16384, production: bool = False) -> DataFrame:
        """Newest value at or before each request (entity_id, ts, request_id), one column per feature.

        Only values of the resolved (latest, or latest production) version of a feature answer.
        """
        s = Series(keys=("feature", "entity_id"), ts="ts", tie=("request_id",), block_rows=block_rows)
        wanted = requests.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        chosen = self.resolve(production).filter(c("feature").isin(list(features)))
        values = self.read(features).join(F.broadcast(chosen), ["feature", "version"], "left_semi").withColumn("request_id", F.lit(None).cast(requests.schema["request_id"].dataType))
        hit = asof_join(wanted, values, s, ["value"])
        return hit.groupBy("request_id", "entity_id", "ts").pivot("feature", list(features)).agg(F.max("value"))

    def statistics(self) -> DataFrame:
        """Count, moments and p25 ... p99 per feature and version."""
        v = self._values()
        by = ["feature", "version"]
        base = v.groupBy(*by).agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            F.max("value").alias("max"), sample_skew("value").alias("skew"), sample_kurtosis("value").alias("kurtosis"))
        return base.join(quantiles(v, "value", (0.25, 0.5, 0.75, 0.95, 0.99), by), by)

    def delete(self, feature: str, version: int | None = None, seq: int | None = None) -> int:
        """Remove the values of a feature (or one version) and mark its metadata deleted."""
        seq = self.next_seq() if seq is None else seq
        cond = c("feature") == feature
        if version is not None:
            cond = cond & (c("version") == version)
        removed = self._values().filter(cond).count()
        gone = [(feature, r["version"], "deleted", "", "double", [], seq) for r in self.metadata().filter(cond).select("version").toLocalIterator()]
        if gone:
            self.register_all(gone)
        remove_path(self.spark, f"{self.root}/values/feature={feature}" + ("" if version is None else f"/version={version}"))
        return removed
