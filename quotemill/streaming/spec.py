"""A configured stream: source -> checks -> transforms -> sink, as one query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quotemill.operators.project import compose
from quotemill.operators.quality import validate
from quotemill.sources.store import stream_table
from quotemill.streaming.jobs import Batch, batch_writer, held, start


@dataclass
class StreamSpec:
    """What a stream reads, how it checks and changes rows, and where they go.

    Invalid rows are kept apart in ``<sink>/rejected``; transforms run per micro-batch on the valid rows.
    """

    path: str
    schema: T.StructType
    sink: str
    checkpoint: str
    fmt: str = "parquet"
    files_per_trigger: int | None = None
    checks: list[Column] = field(default_factory=list)
    transforms: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    writer: Callable[[str], Batch] = batch_writer

    def run(self, spark: SparkSession, every: str | None = None) -> StreamingQuery:
        source = stream_table(spark, self.path, self.schema, self.fmt, self.files_per_trigger)
        accept, reject = self.writer(f"{self.sink}/accepted"), self.writer(f"{self.sink}/rejected")

        def handle(df: DataFrame, batch: int) -> None:
            checked = validate(df, self.checks) if self.checks else None
            good = df if checked is None else checked.filter("valid").drop("issues", "valid")
            accept(compose(*self.transforms)(good), batch)
            if checked is not None:
                reject(checked.filter("NOT valid").drop("valid"), batch)

        return start(source, held(handle), self.checkpoint, every=every)


def from_config(config: dict, schema: T.StructType, checks: list[Column], transforms: list[Callable[[DataFrame], DataFrame]]) -> StreamSpec:
    """Build a spec from plain settings (path, sink, checkpoint, format, files_per_trigger)."""
    return StreamSpec(path=config["path"], schema=schema, sink=config["sink"], checkpoint=config["checkpoint"], fmt=config.get("format", "parquet"),
                      files_per_trigger=config.get("files_per_trigger"), checks=checks, transforms=transforms)
