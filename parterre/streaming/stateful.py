"""The allocator as a stateful operator: one keyed state per section, kept by Spark's state store.

Set-ups and commands of a section meet in one processor, whose state is the
section's free runs. A micro-batch's rows of a section are taken in time order.

A section may have more rows in a micro-batch than a task should hold. As long
as no seats come back, only the first ``free // n`` requests for ``n`` seats can
be served; beyond ``most_rows``, the others are moved to a list in the state
store while the batch is read, and leave from there as the rejections they are.
What is held is bounded by the section's seats. A set-up within the batch gives
the section new seats; then the list is gone through once more, by set-up.
"""

from __future__ import annotations

import contextlib
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parterre.operators import allocate as A
from parterre.operators.fold import COMMAND, INIT, FreeRuns
from parterre.schemas import SECTION
from parterre.streaming.runs import process_available
from parterre.streaming.sinks import route_sinks, send_route

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = ("kind int, reservation_id string, event_id long, section string, seat_count int, user_id string, ts timestamp_ntz, "
          "epoch long, first_seat int, available_count int, prefiltered boolean")
_OUTPUT_ROW = Row(*(c.split()[0] for c in OUTPUT.split(", ")))
_RUNS = "epoch long, starts array<int>, stops array<int>"
_REQUEST = "ts timestamp_ntz, reservation_id string, seat_count int, user_id string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that leave at once.
_CHUNK = 10_000

Request = tuple  # (ts, reservation_id, seat_count, user_id), which is also its order


def first_of_each_size(requests: list[Request], free: list[int], opened: list) -> tuple[list[Request], list[Request]]:
    """(requests that may be served, all others), both in order.

    ``free[k]`` seats are there from the ``k``-th set-up on, which was at ``opened[k - 1]``.
    """
    kept, others, seen = [], [], Counter()
    for request in sorted(requests):
        epoch, size = bisect_right(opened, request[0]), request[2]
        if size > 0 and seen[epoch, size] < free[epoch] // size:
            seen[epoch, size] += 1
            kept.append(request)
        else:
            others.append(request)
    return kept, others


class SeatProcessor(StatefulProcessor):
    """Allocates the seats of one section, micro-batch after micro-batch."""

    def __init__(self, shed: bool, most_rows: int) -> None:
        self.shed, self.most_rows = shed, most_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", _RUNS)
        self.late = handle.getListState("late", _REQUEST)
        self.later = handle.getListState("later", _REQUEST)

    def handleInitialState(self, key, initial: Row, timers) -> None:
        self.runs.update((initial.epoch, initial.run_starts, initial.run_stops))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        runs = FreeRuns()
        if self.runs.exists():
            epoch, starts, stops = self.runs.get()
            runs.reset(starts, stops, epoch)
        before = runs.available
        held, inits, spilled = self._gathered(rows, before or 0)
        inits.sort()
        if spilled and inits:
            held = self._gone_through(held, inits, before or 0)
        turned_away = before if self.shed and not inits else None
        yield from self._served(key, runs, sorted(held), inits, turned_away)
        spill = self.later if inits else self.late
        if spilled:
            yield from self._refused(key, spill)
            for spill in (self.late, self.later):
                spill.clear()
        if runs.available is not None:
            self.runs.update((runs.epoch, *runs.live_runs()))

    def close(self) -> None:
        pass

    def _gathered(self, rows: Iterator[Row], free: int) -> tuple[list[Request], list[tuple], bool]:
        held: list[Request] = []
        inits: list[tuple] = []
        limit, spilled = self.most_rows, False
        for row in rows:
            if row.kind == INIT:
                inits.append((row.ts, row.step, row.run_starts, row.run_stops))
                continue
            held.append((row.ts, row.reservation_id, row.seat_count, row.user_id))
            if len(held) > limit:
                held, others = first_of_each_size(held, [free], [])
                self._spill(self.late, others)
                spilled = spilled or bool(others)
                limit = max(self.most_rows, 2 * len(held))
        return held, inits, spilled

    @staticmethod
    def _spill(spill, requests: list[Request]) -> None:
        for at in range(0, len(requests), _CHUNK):
            spill.appendList(requests[at: at + _CHUNK])

    def _gone_through(self, held: list[Request], inits: list[tuple], free: int) -> list[Request]:
        """Which of the held and spilled requests may be served, now that the set-ups are known; the others go to ``later``."""
        opened, free_of = [i[0] for i in inits], [free, *(sum(i[3]) - sum(i[2]) for i in inits)]
        limit = 0
        for request in self.late.get():
            held.append(tuple(request))
            if len(held) > max(limit, self.most_rows):
                held, others = first_of_each_size(held, free_of, opened)
                self._spill(self.later, others)
                limit = 2 * len(held)
        return held

    def _served(self, key, runs: FreeRuns, requests: list[Request], inits: list[tuple], turned_away: int | None) -> Iterator[Row]:
        """Set-ups and requests in turn; notes what was left when, for those that are refused without a turn."""
        self._times, self._left = [], [(runs.epoch, runs.available)]
        at = 0
        for number in range(len(inits) + 1):
            if number:
                ts, step, starts, stops = inits[number - 1]
                runs.reset(starts, stops, step)
                self._note(ts, runs)
                yield from self._rows(key, INIT, [(ts, None, None, None)], [runs.epoch], [None], [runs.available], False)
            stop = len(requests) if number == len(inits) else next(
                (k for k in range(at, len(requests)) if requests[k][0] >= inits[number][0]), len(requests))
            segment = requests[at:stop]
            early = [r for r in segment if turned_away is not None and r[2] > turned_away]
            if early:
                yield from self._rows(key, COMMAND, early, [None] * len(early), [None] * len(early), [None] * len(early), True)
                segment = [r for r in segment if r[2] <= turned_away]
            first: list[int | None] = [None] * len(segment)
            taken = np.zeros(len(segment), np.int64)
            opening = runs.available
            if runs.refused > 1:
                runs.serve([r[2] for r in segment], 0, first, taken)
            left = [None] * len(segment) if opening is None else (opening - np.cumsum(taken)).tolist()
            for k in np.flatnonzero(taken).tolist():
                self._times.append(segment[k])
                self._left.append((runs.epoch, left[k]))
            if segment:
                yield from self._rows(key, COMMAND, segment, [runs.epoch] * len(segment), first, left, False)
            at = stop
        self._turned_away = turned_away

    def _note(self, ts, runs: FreeRuns) -> None:
        self._times.append((ts,))
        self._left.append((runs.epoch, runs.available))

    def _refused(self, key, spill) -> Iterator[Row]:
        chunk: list[Request] = []
        for request in spill.get():
            chunk.append(tuple(request))
            if len(chunk) == _CHUNK:
                yield from self._refusals(key, chunk)
                chunk = []
        yield from self._refusals(key, chunk)

    def _refusals(self, key, chunk: list[Request]) -> Iterator[Row]:
        bar = self._turned_away
        early = [r for r in chunk if bar is not None and r[2] > bar]
        rest = [r for r in chunk if bar is None or r[2] <= bar]
        if early:
            yield from self._rows(key, COMMAND, early, [None] * len(early), [None] * len(early), [None] * len(early), True)
        if rest:
            epochs, left = zip(*[self._left[bisect_right(self._times, r)] for r in rest])
            yield from self._rows(key, COMMAND, rest, list(epochs), [None] * len(rest), list(left), False)

    @staticmethod
    def _rows(key, kind: int, requests: list[Request], epochs: list, first: list, left: list, prefiltered: bool) -> Iterator[Row]:
        for (ts, reservation_id, seat_count, user_id), epoch, seat, available in zip(requests, epochs, first, left):
            yield _OUTPUT_ROW(kind, reservation_id, key[0], key[1], seat_count, user_id, ts, epoch, seat, available, prefiltered)


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk beside the executors and in the checkpoint."""
    previous = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if previous is None else spark.conf.set(_PROVIDER, previous)


class StatefulRoute:
    """The route with its state in Spark's state store, sending to separate sinks below ``folder``.

    ``initial`` are section states to begin with, taken when the stream first starts. ``shed`` marks requests for more seats
    than a section had at the start of the micro-batch as turned away at the door.
    """

    def __init__(self, spark: SparkSession, folder: str, *, shed: bool = False, initial: DataFrame | None = None, most_rows: int = 100_000) -> None:
        self.spark, self.folder, self.initial = spark, folder, initial
        self.processor = SeatProcessor(shed, most_rows)
        self.sinks = route_sinks(spark, f"{folder}/sinks")
        self.checkpoint = f"{folder}/checkpoint"

    def run(self, commands: DataFrame, inits: DataFrame) -> None:
        """Process what has arrived; a later call resumes from the checkpoint."""
        timeline = A.command_rows(commands).unionByName(A.init_rows(inits))
        begin = None if self.initial is None else self.initial.select(*SECTION, "epoch", "run_starts", "run_stops").groupBy(*SECTION)
        with on_rocksdb(self.spark):
            outcome = timeline.groupBy(*SECTION).transformWithState(self.processor, OUTPUT, "Append", "None", begin)
            process_available(outcome, self.checkpoint, self.handle)

    def handle(self, outcome: DataFrame, batch: int) -> None:
        send_route(self.sinks, outcome, batch)

    def completed(self) -> DataFrame:
        return self.sinks.read("completed").drop("batch").withColumnRenamed("ts", "completed_ts")

    def changelog(self) -> DataFrame:
        return self.sinks.read("status").drop("batch").withColumnRenamed("ts", "status_ts")

    def states(self) -> DataFrame:
        """The free runs of each section, read from the state store of the last micro-batch."""
        stored = self.spark.read.format("statestore").option("stateVarName", "runs").load(self.checkpoint)
        seats = lambda name: F.aggregate(name, F.lit(0), lambda n, x: n + x)
        return stored.select("key.*", "value.*").select(
            *SECTION, "epoch", (seats("stops") - seats("starts")).alias("available_count"),
            F.col("starts").alias("run_starts"), F.col("stops").alias("run_stops"))
