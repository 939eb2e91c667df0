"""A message log on shared storage with a broker's columns, for pipelines without a broker and for replays.

The sink gives every message the next offset of its partition and writes the messages of a batch as files sorted by
partition and offset; a small index names each file's offsets.  The index of a batch is written last and is what readers go by: a
batch that was cut off is written again under the same offsets, one that is indexed is left alone.

The source reads a range of offsets per partition, file by file, in as many tasks as there are files; the stream's
checkpoint holds the offsets, so a restart neither loses nor repeats a message.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quotemill.operators.ordered import Series, index_rows
from quotemill.session import has_data, qualified
from quotemill.streaming.jobs import Batch, held

# The columns of a broker's messages.
MESSAGE = ("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
           "headers array<struct<key: string, value: binary>>")
COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp", "headers"]
_INDEX = "file string, partition int, first bigint, last bigint"


def log_sink(path: str, topic: str, partitions: int = 4, partition: Column | None = None, tie: str | None = None) -> Batch:
    """Handler that appends the batches of a stream with columns ``key``, ``value``, ``timestamp`` and perhaps ``headers``.

    Messages go to the partition named by ``partition`` or else by the hash of their key, and follow each other by time and
    ``tie`` (a column that is not written; key and value by default).  A null key is a key.
    """
    where = F.coalesce(partition, F.lit(0)) if partition is not None else F.pmod(F.xxhash64("key"), F.lit(partitions))

    def write(df: DataFrame, batch: int) -> None:
        spark, data, index = df.sparkSession, f"{path}/data/batch={batch}", f"{path}/index/batch={batch}"
        if has_data(spark, index):
            return
        order = F.col(tie).cast("string") if tie else F.concat_ws("\0", F.col("key").cast("string"), F.col("value").cast("string"))
        headers = F.col("headers") if "headers" in df.columns else F.lit(None).cast("array<struct<key: string, value: binary>>")
        rows = df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(topic).alias("topic"),
                         where.cast("int").alias("partition"), F.col("timestamp").cast("timestamp").alias("timestamp"), headers.alias("headers"),
                         F.length(order).alias("_size"), order.alias("_tie"))
        placed = index_rows(rows, Series(keys=("partition",), ts="timestamp", tie=("_size", "_tie")), "_at")
        before = ends(spark, path, batch)
        base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("partition")), F.lit(0)) if before else F.lit(0)
        out = placed.withColumn("offset", (base + F.col("_at")).cast("bigint")).select(*COLUMNS)
        out.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").write.mode("overwrite").parquet(data)
        written = spark.read.parquet(data).select("partition", "offset", F.col("_metadata.file_path").alias("file"))
        spans = written.groupBy("file", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
        spans.coalesce(1).write.mode("overwrite").parquet(index)

    return held(write)


def ends(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The next offset of every partition, of all batches or those before one: as many rows as partitions."""
    if not has_data(spark, f"{path}/index"):
        return {}
    index = spark.read.schema(f"{_INDEX}, batch bigint").option("basePath", f"{path}/index").parquet(f"{path}/index")
    if before is not None:
        index = index.filter(F.col("batch") < before)
    return {r["partition"]: r["end"] + 1 for r in index.groupBy("partition").agg(F.max("last").alias("end")).collect()}


@dataclass
class Span(InputPartition):
    file: str
    partition: int
    first: int
    end: int


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Log:
    """The index of a log and the reading of its files; pickled to the tasks."""

    def __init__(self, path: str, topics: list[str] | None):
        self.path, self.topics = path, topics

    def index(self) -> list[tuple[str, int, int, int]]:
        files, base = _open(f"{self.path}/index")
        if files.get_file_info(base).type == pafs.FileType.NotFound:
            return []
        found = [f.path for f in files.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".parquet")]
        # A batch's index appears as a whole; one in the making lies below a folder that starts with an underscore.
        found = [f for f in found if not any(part.startswith(("_", ".")) for part in f[len(base) :].split("/"))]
        rows = pads.dataset(found, filesystem=files, format="parquet").to_table().to_pylist() if found else []
        return [(r["file"], r["partition"], r["first"], r["last"]) for r in rows]

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        out = []
        for file, p, first, last in sorted(self.index()):
            lo, hi = max(first, start.get(str(p), 0)), min(last + 1, end.get(str(p), 0))
            if lo < hi:
                out.append(Span(file, p, lo, hi))
        return out

    def ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, p, _, last in self.index():
            out[str(p)] = max(out.get(str(p), 0), last + 1)
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        files, name = _open(span.file)
        wanted = (pads.field("partition") == span.partition) & (pads.field("offset") >= span.first) & (pads.field("offset") < span.end)
        if self.topics:
            wanted = wanted & pads.field("topic").isin(self.topics)
        for batch in pads.dataset(name, filesystem=files, format="parquet").to_batches(filter=wanted, columns=COLUMNS, batch_size=4096):
            if batch.num_rows:
                at = COLUMNS.index("timestamp")
                yield batch.set_column(at, "timestamp", batch.column(at).cast(pa.timestamp("us", "UTC")))


class _BatchReader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self) -> list[Span]:
        return self.log.spans({}, self.log.ends()) or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, log: _Log, starting: str):
        self.log, self.starting = log, starting

    def initialOffset(self) -> dict:
        return self.log.ends() if self.starting == "latest" else {}

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.log.spans(start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)


class RecordLog(DataSource):
    """``spark.read`` or ``spark.readStream`` with format ``record_log``: options ``path``, ``subscribe`` (topics, with commas)
    and ``startingOffsets`` (``earliest`` or ``latest``, for a stream without checkpoint).
    """

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return MESSAGE

    def _log(self) -> _Log:
        topics = self.options.get("subscribe")
        return _Log(self.options["path"], topics.split(",") if topics else None)

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self._log())

    def streamReader(self, schema) -> DataSourceStreamReader:
        starting = self.options.get("startingOffsets", "earliest")
        if starting not in ("earliest", "latest"):
            raise ValueError("startingOffsets is earliest or latest")
        return _StreamReader(self._log(), starting)


def read_log(spark: SparkSession, path: str, topics: str | None = None, starting_offsets: str = "earliest", stream: bool = True) -> DataFrame:
    """The messages of a log, as a stream or all there are."""
    spark.dataSource.register(RecordLog)
    options = {"path": qualified(spark, path), "startingOffsets": starting_offsets} | ({"subscribe": topics} if topics else {})
    reader = spark.readStream if stream else spark.read
    return reader.format("record_log").options(**options).load()
