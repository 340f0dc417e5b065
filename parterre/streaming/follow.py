"""Tables and feeds that follow the stream of completed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.operators.relational import events_with_changes
from parterre.streaming.runs import process_available
from parterre.streaming.sinks import Sinks
from parterre.streaming.upsert import BucketedTable


class LatestTable:
    """The latest row per key of a stream, queryable between batches.

    A batch merges its rows into the hash buckets of its keys and leaves the others alone.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], order: list[str],
                 buckets: int = 16) -> None:
        self.folder = folder
        self.table = BucketedTable(spark, f"{folder}/rows", schema, keys, order, buckets)

    def run(self, stream: DataFrame) -> None:
        process_available(stream, f"{self.folder}/checkpoint", self.table.upsert)

    def read(self) -> DataFrame:
        return self.table.read()

    def as_of(self, batch: int) -> DataFrame:
        """The table after ``batch``."""
        return self.table.as_of(batch)


class ChangedEvents:
    """Per batch, the events whose availability a confirmed result has changed."""

    schema = T.StructType([T.StructField("event_id", T.LongType())])

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder
        self.sinks = Sinks(spark, f"{folder}/changes", {"events": self.schema})

    def run(self, completed: DataFrame) -> None:
        process_available(completed, f"{self.folder}/checkpoint", self.handle)

    def handle(self, arrived: DataFrame, batch: int) -> None:
        self.sinks.write(events_with_changes(arrived), F.array(F.lit("events")), batch)

    def read(self) -> DataFrame:
        return self.sinks.read("events")


def status_feed(changelog: DataFrame, event_id: int) -> DataFrame:
    """The availability updates of one event; works on a stream as on a table."""
    return changelog.where(F.col("event_id") == event_id).select(
        "event_id", "section", "available_count", "status_ts")
