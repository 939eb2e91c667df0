"""Exact deduplication as a stream with keyed state on disk.

A table's files arrive as micro-batches.  The state, kept in RocksDB without expiry, holds one entry per digest: the
digest, how many rows had it, and of the row that stays its identifier and its content locator (file and row number
in the table; the text itself is never kept).  Rows are combined in the tasks that read them, so a text
that fills a third of the table reaches the state as one row per task.  A later call with the same folder
goes on from the checkpoint and reads new files only.

A digest that occurs twice is a hit, and hits are checked on their full bytes: the rows of digests with hits are grouped
by their whole text, and the text at the locator must be the only one.  Digests that fail get entries by whole text
in a table of their own, so the result is exact whatever digest is used.  Only rows that may be hits are
read for that: their digests fall into one of ``HIT_BUCKETS`` marked buckets, a table of bounded size.

Defined results: a null text counts as empty, and empty texts are equal to each other.  Of equal texts the row with the
largest id stays; a row without id only if none has one; among equal ids the one further back in the table.  Repeated
rows are copies of each other.  An empty table gives no rows.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from quotemill.session import ROCKSDB, _located, materialize, path_exists, scratch
from quotemill.streaming.jobs import batch_writer, latest, start

BATCH_BYTES = 256 << 20
HIT_BUCKETS = 1 << 20
# The store for state that outgrows memory; it must not set files' space aside, or many small partitions fill the disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(table: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """Identifier, locator, digest and text of every row of a table read from files, batch or stream."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return table.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col("_metadata.file_path").alias("file"),
                                 F.col("_metadata.row_index").alias("row")).alias("at"),
                        digest(text).alias("digest"), text.alias("text"))


def _entry(groups: GroupedData) -> DataFrame:
    """What an entry holds beside its key."""
    return groups.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))


class Deduplicator:
    """Deduplication of the parquet table at ``path`` with its state in ``folder`` (of the shared storage)."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None,
                 digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES):
        self.spark, self.path, self.folder = spark, path, folder or scratch(spark, "exact")
        self.digest, self.id_col, self.text_col, self.batch_bytes = digest, id_col, text_col, batch_bytes

    def rows(self) -> DataFrame:
        return _rows(self.spark.read.parquet(self.path), self.digest, self.id_col, self.text_col)

    def _arriving(self) -> DataFrame:
        source = self.spark.readStream.schema(self.spark.read.parquet(self.path).schema).option("maxBytesPerTrigger", str(self.batch_bytes))
        files, there = _located(self.spark, self.path)
        if files.exists(there) and files.getFileStatus(there).isFile():  # a stream reads folders, so the file is picked by name
            source = source.option("pathGlobFilter", there.getName())
            return source.parquet(there.getParent().toString())
        return source.parquet(self.path)

    def update(self) -> None:
        """Take in the files that have arrived since the last call, and check the hits."""
        spark, before = self.spark, {k: self.spark.conf.get(k, None) for k in STORE}
        arriving = _rows(self._arriving(), self.digest, self.id_col, self.text_col).select("digest", "at")
        for k, v in STORE.items():
            spark.conf.set(k, v)
        try:
            # Update mode hands out the entries that a batch has changed.
            start(_entry(arriving.groupBy("digest")), batch_writer(f"{self.folder}/state"), f"{self.folder}/checkpoint", "update").awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        rows = self.rows()
        failed = materialize(self._collisions(rows), "exact-failed")
        if not failed.isEmpty():
            _entry(rows.join(failed, "digest").groupBy("digest", "text")).write.mode("overwrite").parquet(f"{self.folder}/whole")

    def _entries(self) -> DataFrame:
        """The state as it is now: per digest the number of rows and the locator of the one that stays."""
        path = f"{self.folder}/state"
        return latest(self.spark.read.option("basePath", path).parquet(path), ["digest"])

    def _collisions(self, rows: DataFrame) -> DataFrame:
        """Digests that stand for more than one text."""
        hits = self._entries().filter("n > 1")
        bucket = F.pmod(F.xxhash64("digest"), F.lit(HIT_BUCKETS))
        marked = hits.select(bucket.alias("bucket")).distinct()
        # At most HIT_BUCKETS numbers, however many hits there are.
        perhaps = rows.withColumn("bucket", bucket).join(F.broadcast(marked), "bucket", "left_semi")
        contents = perhaps.groupBy("digest", "text").agg(F.max("at").alias("held"))
        return contents.drop("text").join(hits.select("digest", "at"), "digest").filter(F.col("held") != F.col("at")).select("digest").distinct()

    def verdicts(self) -> DataFrame:
        """Per row taken in: id, ``keep_id``, ``group_size``, ``kept`` and the digest."""
        rows = self.rows()
        found = rows.select("at", "digest").join(self._entries().withColumnRenamed("at", "keep"), "digest")
        if path_exists(self.spark, f"{self.folder}/whole"):
            whole = self.spark.read.parquet(f"{self.folder}/whole").withColumnRenamed("at", "keep")
            failed = whole.select("digest").distinct()
            found = found.join(failed, "digest", "left_anti").unionByName(rows.join(failed, "digest").join(whole, ["digest", "text"]).drop("text"))
        return found.select(F.col("at.id").alias(self.id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                            (F.col("at") == F.col("keep")).alias("kept"), "digest")


def land(docs: DataFrame) -> str:
    """Write a table that is not in files yet, so that its rows have locators; returns the path."""
    path = scratch(docs.sparkSession, "exact-rows")
    docs.write.parquet(path)
    return path


def deduplicate(docs: DataFrame, **named) -> DataFrame:
    """The verdicts on all rows of any frame (see ``Deduplicator``)."""
    work = Deduplicator(docs.sparkSession, land(docs), **named)
    work.update()
    return work.verdicts()
