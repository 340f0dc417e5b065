"""The reservation route as a streaming query.

Set-ups and commands arrive as one tagged stream. Every micro-batch is judged
against the availability of the sections at its start, replayed from their
states with the batch operators, and sent once to the sinks of requests, results,
completions, statuses and states. Because a micro-batch goes through
the batch replay, a hot section is spread over tasks here as well, and rows are
taken in time order within a batch whatever order the files hold them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.operators.fold import COMMAND, INIT
from parterre.operators.route import route_batch
from parterre.schemas import SECTION
from parterre.session import materialize, scratch
from parterre.streaming.runs import process_available
from parterre.streaming.sinks import route_sinks, send_route
from parterre.streaming.upsert import BucketedTable

def tagged(commands: DataFrame, inits: DataFrame) -> DataFrame:
    """Both inputs as one stream."""
    return inits.withColumn("kind", F.lit(INIT)).unionByName(
        commands.withColumn("kind", F.lit(COMMAND)), allowMissingColumns=True)


class StreamingRoute:
    """State and output of one route below ``folder``.

    Outputs go to separate sinks with one commit a batch. The section states are kept in hash buckets; a batch reads and
    writes those of its sections.
    """

    def __init__(self, spark: SparkSession, folder: str, *, shed: bool = True, buckets: int = 16) -> None:
        self.spark, self.folder, self.shed = spark, folder, shed
        self.sinks = route_sinks(spark, f"{folder}/sinks")
        schema = T.StructType([*self.sinks.layouts["states"], T.StructField("batch", T.IntegerType())])
        self.kept = BucketedTable(spark, f"{folder}/states", schema, SECTION, ["batch"], buckets)

    def run(self, commands: DataFrame, inits: DataFrame) -> None:
        """Process what has arrived; a later call resumes from the checkpoint."""
        process_available(tagged(commands, inits), f"{self.folder}/checkpoint", self.handle)

    def handle(self, arrived: DataFrame, batch: int) -> None:
        with scratch(self.spark):
            # Read back in the main session: with sizes known and adaptive execution on.
            self._handle(materialize(arrived, "micro-batch", self.spark), batch)

    def _handle(self, arrived: DataFrame, batch: int) -> None:
        commands = arrived.where(F.col("kind") == COMMAND)
        inits = arrived.where(F.col("kind") == INIT)
        known = self.kept.match(arrived, before=batch).drop("batch")
        send_route(self.sinks, route_batch(commands, inits, known, shed=self.shed), batch)
        # From what was sent: if this is a repetition, the states are those of the first time.
        self.kept.upsert(self.sinks.read("states", first=batch, stop=batch + 1), batch, stored=True)

    def completed(self) -> DataFrame:
        """Results of all batches: turned away at the door or decided by the allocator."""
        return self.sinks.read("completed").drop("batch").withColumnRenamed("ts", "completed_ts")

    def changelog(self) -> DataFrame:
        return self.sinks.read("status").drop("batch").withColumnRenamed("ts", "status_ts")

    def states(self) -> DataFrame:
        return self.kept.read().drop("batch")
