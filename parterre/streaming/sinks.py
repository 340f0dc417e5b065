"""Several outputs of one micro-batch, all there or none.

What a batch sends to its sinks is one table with a folder for each sink, written
by one job and counted once its commit is there. A batch that failed half way is
written again from the start, and readers never see it before it is whole. One
that was written whole but not committed is only committed when it is handed over
again, so that a stream over the files meets no row twice either.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.functions.seats import section_key
from parterre.operators.fold import COMMAND, INIT, STATE
from parterre.schemas import CONFIRMED, REJECTED
from parterre.sources.files import keyed
from parterre.streaming.commits import Commits, exists

SINK = "sink"


class Sinks:
    """Named outputs below ``folder``, each with its own columns of the rows that are written."""

    def __init__(self, spark: SparkSession, folder: str, layouts: Mapping[str, T.StructType]) -> None:
        self.spark, self.folder, self.layouts = spark, folder, dict(layouts)
        fields = {f.name: f for layout in layouts.values() for f in layout}
        self.schema = T.StructType(list(fields.values()))
        self.commits = Commits(spark, f"{folder}/commits")

    def write(self, rows: DataFrame, wanted: Column, batch: int) -> None:
        """``wanted`` names the sinks of each row in an array; a committed batch is left as it is."""
        if self.commits.has(batch):
            return
        target = f"{self.folder}/data/batch={batch}"
        if not exists(self.spark, f"{target}/_SUCCESS"):
            sent = rows.withColumn(SINK, F.explode(wanted)).select(*self.schema.fieldNames(), SINK)
            sent.write.partitionBy(SINK).mode("overwrite").parquet(target)
        self.commits.put(batch, {})

    def read(self, sink: str, first: int = 0, stop: int | None = None) -> DataFrame:
        """What committed batches (from ``first``, before ``stop``) sent to ``sink``, with the number of the batch."""
        layout = self.layouts[sink]
        batches = [n for n in self.commits.batches() if n >= first and (stop is None or n < stop)]
        schema = T.StructType([*layout, T.StructField("batch", T.IntegerType()), T.StructField(SINK, T.StringType())])
        if not batches:
            return self.spark.createDataFrame([], T.StructType(schema[:-1]))
        paths = [f"{self.folder}/data/batch={n}" for n in batches]
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths)
        return found.where(F.col(SINK) == sink).drop(SINK)

    def stream(self, sink: str) -> DataFrame:
        """What is sent to ``sink``, as a stream."""
        schema = T.StructType([*self.layouts[sink], T.StructField("batch", T.IntegerType()), T.StructField(SINK, T.StringType())])
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/data").where(F.col(SINK) == sink).drop(SINK)

    def records(self, sink: str, key: Column, **bounds: int) -> DataFrame:
        """The same as text keys and JSON values, as a broker's topic takes them."""
        return keyed(self.read(sink, **bounds).drop("batch"), key)


# The sinks of the route: what was asked and is passed on, what the allocator decided, what requesters are told, seats left.
_ID = [T.StructField("reservation_id", T.StringType())]
_PLACE = [T.StructField("event_id", T.LongType()), T.StructField("section", T.StringType())]
_ASKED = [T.StructField("seat_count", T.IntegerType()), T.StructField("user_id", T.StringType())]
_DECIDED = [T.StructField("epoch", T.LongType()), T.StructField("status", T.StringType()), T.StructField("first_seat", T.IntegerType())]
_TIME = [T.StructField("ts", T.TimestampNTZType())]
ROUTE_SINKS = {
    "requests": T.StructType(_ID + _PLACE + _ASKED + _TIME),
    "results": T.StructType(_ID + _PLACE + _ASKED + _DECIDED + _TIME),
    "completed": T.StructType(_ID + _PLACE + _ASKED + _DECIDED + _TIME + [T.StructField("prefiltered", T.BooleanType())]),
    "states": T.StructType(_PLACE + [T.StructField("epoch", T.LongType()), T.StructField("available_count", T.IntegerType()),
                                     T.StructField("run_starts", T.ArrayType(T.IntegerType())), T.StructField("run_stops", T.ArrayType(T.IntegerType()))]),
    "status": T.StructType(_PLACE + [T.StructField("epoch", T.LongType()), T.StructField("kind", T.IntegerType())] + _ID
                           + [T.StructField("available_count", T.IntegerType())] + _TIME),
}
#: A section's records share a key, so that their order survives a broker; a request's and its answer's is the reservation.
ROUTE_KEYS = {"requests": section_key, "status": section_key, "states": section_key, "results": lambda: F.col("reservation_id"), "completed": lambda: F.col("reservation_id")}


def route_sinks(spark: SparkSession, folder: str) -> Sinks:
    return Sinks(spark, folder, ROUTE_SINKS)


def send_route(sinks: Sinks, outcome: DataFrame, batch: int) -> None:
    """Replayed rows (set-ups, commands, and states if they were asked for) to the sinks that want them."""
    command, early = F.col("kind") == COMMAND, F.coalesce("prefiltered", F.lit(False))
    nothing = F.array().cast("array<string>")
    wanted = F.concat(
        F.when(command & ~early, F.array(F.lit("requests"), F.lit("results"))).otherwise(nothing),
        F.when(command, F.array(F.lit("completed"))).otherwise(nothing),
        F.when(F.col("kind") == STATE, F.array(F.lit("states"))).otherwise(nothing),
        F.when(F.col("kind").isin(INIT, COMMAND) & ~early & F.col("available_count").isNotNull(), F.array(F.lit("status"))).otherwise(nothing))
    status = F.when(command, F.when(F.col("first_seat").isNotNull(), F.lit(CONFIRMED)).otherwise(F.lit(REJECTED)))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in sinks.schema if f.name not in [*outcome.columns, "status"]}
    sinks.write(outcome.withColumns({"status": status, **missing}), wanted, batch)
