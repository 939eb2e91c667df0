"""Dead letters that are tried again after a delay, and archived after too many attempts.

The queue is a folder of rows with their attempts so far and the time of the next one.  The live stream puts failing
rows there.  A pass is a run of a second stream over that same folder: it takes what was queued since the last pass, tries
the rows that are due and queues again those that are not due or fail with attempts left.  What a pass writes is keyed
by its batch, and the time of a batch is written before anything else, so a replayed batch gives the same rows in the
same places and nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.quality import validate
from quotemill.session import has_data, path_exists
from quotemill.streaming.jobs import Batch, held, start

c = F.col
PARTS = ("good", "archive", "attempts")


class RetryQueue:
    """Good rows, queue, archive and attempt counts in the folder ``path``.

    ``fix`` gets due rows with column ``attempts`` (1 for the first attempt) and returns them repaired, or as they are.
    """

    def __init__(self, spark: SparkSession, path: str, checks: Sequence[Column], fix: Callable[[DataFrame], DataFrame] = lambda d: d,
                 max_attempts: int = 3, delay: float = 60.0):
        self.spark, self.path, self.checks, self.fix, self.max_attempts, self.delay = spark, path, list(checks), fix, max_attempts, delay

    def _to(self, df: DataFrame, part: str, by: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{part}/by={by}/batch={batch}")

    def _later(self, at: Column) -> Column:
        return at + F.make_dt_interval(secs=F.lit(float(self.delay)))

    def sink(self, now: datetime | None = None) -> Batch:
        """Handler of the live stream: rows that pass the checks are good, the others are queued."""
        def write(df: DataFrame, batch: int) -> None:
            at = self._time("live", batch, now)
            v = validate(df, self.checks).withColumns({"attempts": F.lit(0), "failed_at": at})
            self._to(v.filter("valid").drop("issues", "valid", "failed_at"), "good", "live", batch)
            self._queue(v.filter("NOT valid").drop("valid").withColumn("next_attempt", self._later(at)), "live", batch)

        return held(write)

    def _time(self, by: str, batch: int, now: datetime | None) -> Column:
        """The time of a batch: given or the clock's the first time, the same when it is replayed."""
        place = f"{self.path}/times/by={by}/batch={batch}"
        if not path_exists(self.spark, place):
            when = now or datetime.now(timezone.utc).replace(tzinfo=None)
            self.spark.range(1).select(F.lit(when).cast("timestamp_ntz").alias("at")).coalesce(1).write.parquet(place)
        return F.lit(self.spark.read.parquet(place).first()["at"]).cast("timestamp_ntz")

    def _queue(self, rows: DataFrame, by: str, batch: int) -> None:
        """Queue rows, last of all writes of a batch; a replay that finds them queued leaves them, as a pass may have listed the files."""
        place = f"{self.path}/queue/by={by}/batch={batch}"
        if not has_data(self.spark, place):
            rows.write.mode("overwrite").parquet(place)

    def retry(self, now: datetime | None = None) -> None:
        """One pass over what has been queued since the last one."""
        if not has_data(self.spark, f"{self.path}/queue"):
            return
        schema = self.spark.read.parquet(f"{self.path}/queue").drop("by", "batch").schema
        queued = self.spark.readStream.schema(schema).parquet(f"{self.path}/queue/*/*")

        def write(df: DataFrame, batch: int) -> None:
            at = self._time("retry", batch, now)
            due = df.filter(c("next_attempt") <= at)
            tried = validate(self.fix(due.drop("issues", "next_attempt").withColumn("attempts", c("attempts") + 1)), self.checks).persist()
            try:
                self._to(tried.filter("valid").drop("issues", "valid", "failed_at"), "good", "retry", batch)
                failed = tried.filter("NOT valid").drop("valid")
                self._to(failed.filter(c("attempts") >= self.max_attempts).withColumn("archived_at", at), "archive", "retry", batch)
                outcome = F.when(c("valid"), "recovered").when(c("attempts") >= self.max_attempts, "archived").otherwise("failed")
                self._to(tried.groupBy(c("attempts").alias("attempt"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n")), "attempts", "retry", batch)
                again = failed.filter(c("attempts") < self.max_attempts).withColumn("next_attempt", self._later(at))
                self._queue(df.filter(~(c("next_attempt") <= at)).unionByName(again.select(df.columns)), "retry", batch)
            finally:
                tried.unpersist()

        start(queued, held(write), f"{self.path}/retry-checkpoint").awaitTermination()

    def read(self, part: str) -> DataFrame:
        """``good``, ``archive`` or ``attempts`` as written so far, with the stream (``by``) and batch of every row."""
        if part not in PARTS:
            raise ValueError(f"no part {part!r}")
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")

    def counts(self) -> DataFrame:
        """Attempts made, recovered and archived rows over all passes, each batch counted once."""
        a = self.read("attempts")
        when = lambda outcome: F.coalesce(F.sum(F.when(c("outcome") == outcome, c("n"))), F.lit(0))
        return a.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("retried"), when("recovered").alias("recovered"), when("archived").alias("archived"))
