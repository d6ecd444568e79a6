"""Keeping the index current from a stream of change events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strataseek.functions.runtime import cut
from strataseek.functions.text import language
from strataseek.operators import incremental
from strataseek.sources.store import Tables

EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("arrived_at", T.TimestampNTZType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str | None = None, files_per_trigger: int = 8, since: datetime | None = None) -> DataFrame:
    """A log of change events as a stream: files that are added to a folder. ``since``: only
    events that arrived then or later, so that a new stream needn't begin with the log."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    events = reader.parquet(folder)
    return events if since is None else events.where(F.col("arrived_at") >= F.lit(since).cast("timestamp_ntz"))


def useful(events: DataFrame, known_languages: bool = True) -> DataFrame:
    """Events that can change the index: with a path inside the root and a kind, of a language."""
    ok = F.col("path").isNotNull() & F.col("kind").isin("change", "unlink") & ~F.col("path").startswith("../") & ~F.col("path").startswith("/")
    return events.where(ok & language(F.col("path")).isNotNull() if known_languages else ok)


def maintain(events: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, interval: str | None = "2 seconds", known_languages: bool = True) -> StreamingQuery:
    """Apply each micro-batch of events, coalesced by path. Batches run one after another;
    an empty one does nothing; after a failure the checkpoint gives the batch again, so ``apply`` must be repeatable:
    upserts and deletes by path are. Without an interval all that is there is applied and the
    query ends. A trigger takes the place of a timer, so a last burst is never left over."""

    def batch(df: DataFrame, _: int) -> None:
        events = incremental.coalesced(useful(df, known_languages))
        if not events.isEmpty():
            apply(events)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class LatestState(Tables):
    """The last kind of every path, as a table on disk. A batch is merged into the buckets of
    its paths; a new process goes on from the state on disk, and a batch that is merged
    once more after a failure changes nothing."""

    SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("event_time", T.TimestampNTZType()), T.StructField("seq", T.LongType())])

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        super().__init__(spark, folder, {"latest": self.SCHEMA}, buckets)

    def latest(self) -> DataFrame:
        return self.read("latest")

    def merge(self, batch: DataFrame) -> None:
        batch = cut(batch.select("path", "kind", "event_time", "seq"))
        old = self.latest().join(batch.select("path"), "path", "left_semi")
        self.replace(batch.select("path").distinct(), {"latest": incremental.coalesced(old.unionByName(batch))})
