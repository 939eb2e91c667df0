"""Broker source and sink options.  The connector jar comes with the cluster; nothing here needs it to import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from quotemill.sources.decode import encode_json


def source_options(servers: str, topics: Sequence[str] | str, starting_offsets: str = "latest",
                   include_headers: bool = False, max_per_trigger: int | None = None,
                   fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of a topic subscription.  Expired or lost offsets fail the stream unless ``fail_on_data_loss`` is off."""
    names = topics if isinstance(topics, str) else ",".join(topics)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": names,
        "startingOffsets": starting_offsets,
        "includeHeaders": str(include_headers).lower(),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def read_topics(spark: SparkSession, servers: str, topics: Sequence[str] | str, **kw) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(servers, topics, **kw)).load()


def sink_options(servers: str, topic: str, checkpoint: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append",
                every: str = "10 seconds", name: str | None = None, key: str | None = None) -> DataStreamWriter:
    """A writer for the encoded rows; call ``start()`` on it."""
    w = encode_json(df, key).writeStream.format("kafka").options(**sink_options(servers, topic, checkpoint))
    w = w.outputMode(mode).trigger(processingTime=every)
    return w.queryName(name) if name else w
