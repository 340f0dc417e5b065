"""Repeated requests on a stream: the last accepted request of a key is its state.

The state is kept for the time it matters: an event-time timer removes it once
the watermark has passed. Rows of a micro-batch are taken in time order.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parterre.operators.dedup import SAME, WITHIN
from parterre.schemas import COMMAND
from parterre.streaming.runs import process_available
from parterre.streaming.sinks import Sinks
from parterre.streaming.stateful import on_rocksdb

cloudpickle.register_pickle_by_value(sys.modules[__name__])

JUDGED = T.StructType([*COMMAND, T.StructField("accepted", T.BooleanType()), T.StructField("answered_by", T.StringType())])
_ROW = Row(*JUDGED.fieldNames())


class RequestProcessor(StatefulProcessor):
    def __init__(self, within: dt.timedelta) -> None:
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "ts timestamp_ntz, reservation_id string, millis long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        last = self.accepted.get() if self.accepted.exists() else None
        before = last
        for row in sorted(rows, key=lambda r: (r.ts, r.reservation_id)):
            fresh = last is None or row.ts - last[0] >= self.within
            if fresh:
                last = (row.ts, row.reservation_id, row.millis)
            yield _ROW(row.reservation_id, row.event_id, row.section, row.seat_count, row.user_id, row.ts, fresh, last[1])
        if last != before:
            self.accepted.update(last)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last[2] + self.within // dt.timedelta(milliseconds=1) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


class RepeatedRequests:
    """Judged requests of a stream, below ``folder``. Requests later than ``late`` behind the newest are not judged any more."""

    def __init__(self, spark: SparkSession, folder: str, same: list[str] = SAME, within: dt.timedelta = WITHIN, late: str = "10 minutes") -> None:
        self.spark, self.folder, self.same, self.within, self.late = spark, folder, same, within, late
        self.sinks = Sinks(spark, f"{folder}/sinks", {"accepted": JUDGED, "repeated": JUDGED})

    def run(self, commands: DataFrame) -> None:
        """Process what has arrived; a later call resumes from the checkpoint."""
        with on_rocksdb(self.spark):
            # watermarks take no timestamp without a zone
            timed = commands.withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("millis", F.unix_millis("event_time"))
            keyed = timed.withWatermark("event_time", self.late).groupBy(*self.same)
            judged = keyed.transformWithState(RequestProcessor(self.within), JUDGED, "Append", "EventTime")
            process_available(judged, f"{self.folder}/checkpoint", self.handle)

    def handle(self, judged: DataFrame, batch: int) -> None:
        self.sinks.write(judged, F.array(F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("repeated"))), batch)

    def read(self) -> DataFrame:
        return self.sinks.read("accepted").unionByName(self.sinks.read("repeated")).drop("batch")
