"""Session settings and the shared folder used for checkpoints and written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; cluster sizing stays with the session."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Window work is heavy per byte: merge small shuffle partitions later than the default does.
    conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="quotemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _located(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    files, there = _located(spark, path)
    return files.exists(there)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark means by it, for readers outside Spark."""
    files, there = _located(spark, path)
    whole = files.makeQualified(there).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds any file of a table at any depth; markers and unfinished writes do not count."""
    files, there = _located(spark, path)
    if not files.exists(there):
        return False
    found = files.listFiles(there, True)
    root = files.makeQualified(there).toString()
    while found.hasNext():
        below = found.next().getPath().toString()[len(root) :].split("/")
        if not any(part.startswith(("_", ".")) for part in below):
            return True
    return False


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; one that is not there is no error."""
    files, there = _located(spark, path)
    files.delete(there, True)


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unique path below the shared folder."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Remove every intermediate this process has written so far; frames that still read them end with it.

    Returns the number of paths.  A local session's own temporary folder goes when the process ends anyway.
    """
    gone = [_made.pop() for _ in range(len(_made))]
    for path in gone:
        remove_path(spark, path)
    return len(gone)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back; survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

