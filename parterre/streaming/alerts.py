"""Alerts on request logs: windows of event time whose time-out rate or lag passes a threshold.

The same expressions serve a table and a stream. On a stream a window is judged
once, when the watermark has passed its end; rows that come later still count if
they are within the watermark's delay, and are dropped beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.streaming.runs import process_available
from parterre.streaming.sinks import Sinks

# The proposed thresholds. A share of requests that end without an answer, and a mean time in ms.
TIMEOUT_RATE, SLOW_MS = 0.05, 50.0
ALERT = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("requests", T.LongType()), T.StructField("timeouts", T.LongType()),
    T.StructField("mean_ms", T.DoubleType()), T.StructField("alert", T.StringType()), T.StructField("severity", T.StringType())])


def alert_windows(log: DataFrame, width: str = "1 minute", timeout_rate: float = TIMEOUT_RATE, slow_ms: float = SLOW_MS) -> DataFrame:
    """One row for each window and threshold that it passes. ``log`` has (ts, latency_ms, ok)."""
    late = F.count_if(~F.coalesce("ok", F.lit(False)))
    windows = log.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), late.alias("timeouts"), F.avg("latency_ms").alias("mean_ms"))
    raised = F.array(
        F.when(F.col("timeouts") > timeout_rate * F.col("requests"), F.struct(F.lit("HighTimeoutRate").alias("alert"), F.lit("critical").alias("severity"))),
        F.when(F.col("mean_ms") > slow_ms, F.struct(F.lit("Slowdown").alias("alert"), F.lit("warning").alias("severity"))))
    return windows.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "requests", "timeouts", "mean_ms",
        F.explode(F.array_compact(raised)).alias("a")).select(*ALERT.fieldNames()[:5], "a.*")


class Alerts:
    """The alerts of a stream of requests, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, width: str = "1 minute", late: str = "10 minutes", **thresholds: float) -> None:
        self.folder, self.width, self.late, self.thresholds = folder, width, late, thresholds
        self.sinks = Sinks(spark, f"{folder}/sinks", {"alerts": ALERT})

    def run(self, log: DataFrame) -> None:
        timed = log.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no other type
        raised = alert_windows(timed.withWatermark("ts", self.late), self.width, **self.thresholds)
        process_available(raised, f"{self.folder}/checkpoint", self.handle)

    def handle(self, raised: DataFrame, batch: int) -> None:
        self.sinks.write(raised, F.array(F.lit("alerts")), batch)

    def read(self) -> DataFrame:
        return self.sinks.read("alerts").drop("batch")
