"""The fold gives one answer however Arrow cuts its input."""

import random

import pyarrow as pa
import pytest

from parterre.operators.fold import COMMAND, INIT, STATE, section_fold


def timeline(seed):
    rng = random.Random(seed)
    rows = []
    for event in range(6):
        for section in ("A", "B"):
            if rng.random() < 0.8:
                rows.append((event, section, INIT, None, [1, 9], [5, 9 + rng.randrange(6)], 1))
            for _ in range(rng.randrange(12)):
                rows.append((event, section, COMMAND, rng.choice([None, -1, 0, 1, 2, 3, 5]), [], [], None))
                if rng.random() < 0.1:
                    rows.append((event, section, INIT, None, [1], [rng.randrange(1, 8)], 1))
    names = ["event_id", "section", "kind", "seat_count", "run_starts", "run_stops", "step"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def expected(batch):
    """Seat by seat, row by row."""
    out, key, free, epoch = [], None, None, 0
    for row in batch.to_pylist():
        if (row["event_id"], row["section"]) != key:
            key, free, epoch = (row["event_id"], row["section"]), None, 0
        first, n = None, row["seat_count"] or 0
        if row["kind"] == INIT:
            free = [s for a, b in zip(row["run_starts"], row["run_stops"]) for s in range(a, b)]
            epoch += 1
        elif free and n > 0:
            first = next((s for s in free if all(s + i in free for i in range(n))), None)
            if first is not None:
                free = [s for s in free if not first <= s < first + n]
        out.append((epoch, first, None if free is None else len(free)))
    return out


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_any_batch_size(seed, size):
    whole = timeline(seed)
    parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
    rows = [r for b in section_fold(["event_id", "section"], True)(iter(parts)) for r in b.to_pylist()]
    seen = [(r["epoch"], r["first_seat"], r["available_count"]) for r in rows if r["kind"] != STATE]
    assert seen == expected(whole)
    states = {(r["event_id"], r["section"]): r for r in rows if r["kind"] == STATE}
    last = {}
    for row, (epoch, _, left) in zip(whole.to_pylist(), expected(whole)):
        last[row["event_id"], row["section"]] = (epoch, left)
    known = {k: v for k, v in last.items() if v[1] is not None}
    assert {k: (s["epoch"], s["available_count"]) for k, s in states.items()} == known
    assert all(sum(s["run_stops"]) - sum(s["run_starts"]) == s["available_count"] for s in states.values())
