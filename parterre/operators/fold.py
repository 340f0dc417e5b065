"""The ordered fold over one section, and its Arrow form.

The fold is the only step Spark's built-in operators cannot express: whether a
request succeeds depends on the outcome of every request before it. Spark
partitions and sorts the rows; the function below walks them once, holding the
free runs of one section at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INIT, COMMAND, STATE = 0, 1, 2


NO_LIMIT = 1 << 31


class FreeRuns:
    """Free seats of one section as ascending runs ``[start, stop)``.

    A request takes the front of the lowest run that is long enough. Runs only
    ever shrink, so a run too short for ``n`` seats stays too short, and the
    search for ``n`` resumes where the last one ended. For the same reason a
    size that found no run never will: ``refused`` is the smallest such size.
    """

    __slots__ = ("starts", "stops", "available", "epoch", "refused", "_resume")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.available: int | None = None
        self.epoch = 0
        self.refused = 1
        self._resume: dict[int, int] = {}

    def reset(self, starts: list[int], stops: list[int], step: int) -> None:
        self.starts, self.stops = list(starts), list(stops)
        self.available = sum(stops) - sum(starts)
        self.epoch += step
        self.refused = NO_LIMIT
        self._resume = {}

    def serve(self, sizes: list[int], at: int, firsts: list[int | None], taken: np.ndarray) -> None:
        """Serve requests in turn, noting first seats and sizes from position ``at`` on."""
        starts, stops, resume, refused = self.starts, self.stops, self._resume, self.refused
        end, left = len(starts), self.available
        for i, n in enumerate(sizes, at):
            if not 0 < n < refused:
                continue
            run = resume.get(n, 0)
            while run < end and stops[run] - starts[run] < n:
                run += 1
            if run == end:
                refused = n
                if n == 1:
                    break
                continue
            resume[n] = run
            firsts[i] = starts[run]
            starts[run] += n
            taken[i] = n
            left -= n
        self.refused, self.available = refused, left

    def live_runs(self) -> tuple[list[int], list[int]]:
        kept = [(a, b) for a, b in zip(self.starts, self.stops) if b > a]
        return [a for a, _ in kept], [b for _, b in kept]


# What the fold adds to its input, in output order; the last one where the input has a door.
FOLD_FIELDS = [
    pa.field("epoch", pa.int64()),
    pa.field("first_seat", pa.int32()),
    pa.field("available_count", pa.int32()),
]
EARLY_FIELD = pa.field("prefiltered", pa.bool_())
# Columns of the input that end in the fold.
CONSUMED = ("step", "door")
NO_DOOR = 1 << 40


def _new_keys(batch: pa.RecordBatch, keys: list[str], follows: bool) -> np.ndarray:
    """Where a row's keys differ from those of the row before it."""
    n = batch.num_rows
    same = np.ones(n - 1, dtype=bool)
    for key in keys:
        column = batch.column(key)
        equal = pc.equal(column.slice(1), column.slice(0, n - 1))
        same &= pc.fill_null(equal, False).to_numpy(zero_copy_only=False)
    return np.concatenate(([not follows], ~same))


def section_fold(keys: list[str], emit_states: bool) -> Callable:
    """A ``mapInArrow`` function over rows sorted by ``keys`` and time.

    Every input row comes back with its epoch, the first seat it was given and
    the seats left after it. With ``emit_states`` a STATE row with the free runs
    follows the last row of each key. Columns the fold does not need pass
    through without leaving Arrow, and rows are visited one by one only while
    their request might still be served.

    A set-up row may carry a ``door``: requests for more seats than that are
    marked ``prefiltered``. They find none either way, as a door is never less
    than what is free.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, schema = FreeRuns(), None
        last_key: dict | None = None
        door = NO_DOOR
        finished: list[dict] = []

        def close(key: dict) -> None:
            if runs.available is not None:
                starts, stops = runs.live_runs()
                finished.append({
                    **key, "kind": STATE, "epoch": runs.epoch, "available_count": runs.available,
                    "run_starts": starts, "run_stops": stops, "prefiltered": False,
                })

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if schema is None:
                guarded = "door" in batch.schema.names
                schema = pa.schema([f for f in batch.schema if f.name not in CONSUMED] + FOLD_FIELDS + [EARLY_FIELD] * guarded)
            key_at = lambda i: {k: batch.column(k)[i].as_py() for k in keys}
            new = _new_keys(batch, keys, follows=key_at(0) == last_key)
            init = batch.column("kind").to_numpy(zero_copy_only=False) == INIT
            opening = batch.filter(pa.array(init))
            openings = zip(*(opening.column(c).to_pylist() for c in ("run_starts", "run_stops", "step")))
            if guarded:
                doors = iter(pc.fill_null(opening.column("door").cast(pa.int64()), NO_DOOR).to_pylist())
            asked = pc.fill_null(batch.column("seat_count"), 0).to_numpy(zero_copy_only=False)
            sizes = asked.tolist()
            firsts: list[int | None] = [None] * n
            taken = np.zeros(n, dtype=np.int64)

            # Between two set-ups or keys lies a segment: requests to one inventory.
            breaks = new | init
            breaks[0] = True
            edges = np.flatnonzero(breaks)
            opened, epochs, limits = (np.empty(len(edges), dtype=np.int64) for _ in range(3))
            bounds = zip(edges.tolist(), [*edges[1:].tolist(), n], new[edges].tolist(), init[edges].tolist())
            for j, (at, stop, starts_key, is_init) in enumerate(bounds):
                if starts_key:
                    if emit_states and (at or last_key is not None):
                        close(key_at(at - 1) if at else last_key)
                    runs, door = FreeRuns(), NO_DOOR
                if is_init:
                    runs.reset(*next(openings))
                    door = next(doors) if guarded else NO_DOOR
                limits[j] = door
                opened[j] = -1 if runs.available is None else runs.available
                epochs[j] = runs.epoch
                if runs.refused > 1:
                    first = at + is_init
                    runs.serve(sizes[first:stop], first, firsts, taken)
            last_key = key_at(n - 1)

            # Seats left: what the segment opened with, less what was taken in it so far.
            lengths = np.diff([*edges, n])
            through = np.cumsum(taken)
            before = np.repeat(through[edges] - taken[edges], lengths)
            opened = np.repeat(opened, lengths)
            added = [
                pa.array(np.repeat(epochs, lengths), pa.int64()),
                pa.array(firsts, pa.int32()),
                pa.array(opened - (through - before), mask=opened < 0).cast(pa.int32()),
            ]
            if guarded:
                added.append(pa.array((asked > np.repeat(limits, lengths)) & ~init))
            passed = [batch.column(f.name) for f in batch.schema if f.name not in CONSUMED]
            yield pa.RecordBatch.from_arrays(passed + added, schema=schema)
            if finished:
                yield pa.RecordBatch.from_pylist(finished, schema=schema)
                finished.clear()
        if emit_states and last_key is not None:
            close(last_key)
        if finished:
            yield pa.RecordBatch.from_pylist(finished, schema=schema)

    return fold
