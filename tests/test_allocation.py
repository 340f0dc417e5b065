"""Golden cases of the allocator and of section set-up, and its edge rules."""

import pytest

from parterre.operators import allocate as A
from parterre.operators import inventory as I
from tests.conftest import make_commands, make_inits

C, R = "CONFIRMED", "REJECTED"

# name, set-ups, requests, expected {id: (status, seats)}, statuses after each request
CASES = [
    ("allocates the lowest run", [(1, "A", 1, 5, [])], [("r1", 1, "A", 3)],
     {"r1": (C, ["A-1", "A-2", "A-3"])}, [2]),
    ("too few seats", [(1, "A", 1, 2, [])], [("r1", 1, "A", 3)], {"r1": (R, [])}, [2]),
    ("no run long enough", [(1, "A", 1, 5, ["A-2"]), (2, "B", 1, 5, ["B-3"])], [("r1", 2, "B", 3)],
     {"r1": (R, [])}, [4]),
    ("takes all seats", [(1, "A", 1, 3, [])], [("r1", 1, "A", 3)], {"r1": (C, ["A-1", "A-2", "A-3"])}, [0]),
    ("sold out", [(1, "A", 1, 3, ["A-1", "A-2", "A-3"])], [("r1", 1, "A", 1)], {"r1": (R, [])}, [0]),
    ("unknown section", [], [("r1", 99, "Z", 1)], {"r1": (R, [])}, []),
    ("one after the other", [(1, "A", 1, 5, [])], [(f"r{i}", 1, "A", 2) for i in (1, 2, 3)],
     {"r1": (C, ["A-1", "A-2"]), "r2": (C, ["A-3", "A-4"]), "r3": (R, [])}, [3, 1, 1]),
    ("status after a rejection", [(1, "A", 1, 2, [])], [("r1", 1, "A", 5)], {"r1": (R, [])}, [2]),
    ("runs cross rows", [(1, "A", 2, 3, [])], [("r1", 1, "A", 4)],
     {"r1": (C, ["A-1", "A-2", "A-3", "A-4"])}, [2]),
    ("numbers, not text, are in order", [(1, "A", 1, 12, [])],
     [(f"s{i}", 1, "A", 1) for i in range(9)] + [("r1", 1, "A", 2)], {"r1": (C, ["A-10", "A-11"])}, None),
    ("reserved names match exactly", [(1, "A", 1, 3, ["A-001", "A-+1", "B-2", "A-4", "A-x"])], [("r1", 1, "A", 3)],
     {"r1": (C, ["A-1", "A-2", "A-3"])}, [0]),
    ("nothing and less than nothing", [(1, "A", 1, 3, [])], [("r1", 1, "A", 0), ("r2", 1, "A", -1)],
     {"r1": (R, []), "r2": (R, [])}, [3, 3]),
    ("a dash in the section", [(1, "VIP-A", 1, 3, [])], [("r1", 1, "VIP-A", 2)],
     {"r1": (C, ["VIP-A-1", "VIP-A-2"])}, [1]),
    ("a repeated reservation id", [(1, "A", 1, 3, [])], [("r1", 1, "A", 1, 0), ("r1", 1, "A", 1, 1)], None, [2, 1]),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_golden(spark, case):
    _, inits, requests, expected, left = case
    commands, sections = make_commands(spark, requests), make_inits(spark, inits)
    if expected is not None:
        rows = A.with_seat_names(A.allocate_seats(commands, sections)).collect()
        assert len(rows) == len(requests)
        seen = {r.reservation_id: (r.status, r.allocated_seats) for r in rows}
        assert {k: seen[k] for k in expected} == expected
    if left is not None:
        changes = A.status_changelog(commands, sections).where("kind = 1").orderBy("status_ts", "reservation_id")
        assert [r.available_count for r in changes.collect()] == left


def test_re_init_starts_a_new_epoch(spark):
    inits = make_inits(spark, [(1, "A", 1, 2, []), (1, "A", 1, 2, [], 10)])
    rows = A.with_seat_names(A.allocate_seats(
        make_commands(spark, [("r1", 1, "A", 2, 0), ("r2", 1, "A", 2, 20)]), inits)).orderBy("completed_ts").collect()
    assert [(r.status, r.allocated_seats, r.epoch) for r in rows] == [
        (C, ["A-1", "A-2"], 1), (C, ["A-1", "A-2"], 2)]


def test_set_up_precedes_a_command_of_its_time(spark):
    rows = A.allocate_seats(make_commands(spark, [("r1", 1, "A", 1, 5)]),
                            make_inits(spark, [(1, "A", 1, 1, [], 5)])).collect()
    assert rows[0].status == C


def test_a_hundred_seats_in_pairs(spark):
    rows = A.allocate_seats(make_commands(spark, [(f"r{i:02}", 1, "A", 2) for i in range(60)]),
                            make_inits(spark, [(1, "A", 1, 100, [])])).collect()
    assert sorted(r.first_seat for r in rows if r.status == C) == list(range(1, 100, 2))
    assert sum(r.status == R for r in rows) == 10


def test_seat_inventory(spark):
    inits = make_inits(spark, [(1, "A", 2, 3, ["A-1", "A-2"]), (2, "E", 0, 5, []), (3, "F", 3, 0, []),
                               (4, "G", 2, 3, ["G-1"]), (4, "G", 1, 2, [], 5)])
    seats = {(r.section, r.seat): r.status for r in I.seat_inventory(inits).collect()}
    assert seats == {
        ("A", "A-1"): "RESERVED", ("A", "A-2"): "RESERVED", ("A", "A-3"): "AVAILABLE", ("A", "A-4"): "AVAILABLE",
        ("A", "A-5"): "AVAILABLE", ("A", "A-6"): "AVAILABLE", ("G", "G-1"): "AVAILABLE", ("G", "G-2"): "AVAILABLE"}
    counts = {r.section: r.available_count for r in I.section_init_status(inits).collect()}
    assert counts == {"A": 4, "E": 0, "F": 0, "G": 2}
    changes = A.status_changelog(make_commands(spark, []), inits)
    assert sorted((r.section, r.available_count) for r in changes.collect()) == [
        ("A", 4), ("E", 0), ("F", 0), ("G", 2), ("G", 5)]


def test_final_inventory_maps_and_runs(spark):
    inits = make_inits(spark, [(1, "A", 1, 12, ["A-3"])])
    commands = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 4)])
    results = A.allocate_seats(commands, inits)
    seats = I.seat_inventory_final(inits, A.seats_taken(results))
    record = I.seat_maps(seats).select(
        "seat_statuses", "available_count", I.available_seat_list(I.F.col("seat_statuses")).alias("free")).first()
    assert record.available_count == 5
    assert record.free == ["A-8", "A-9", "A-10", "A-11", "A-12"]
    assert record.seat_statuses["A-4"] == "RESERVED"
    states = A.final_states(commands, inits)
    assert sorted(map(tuple, seats.collect())) == sorted(map(tuple, I.seat_inventory_of_states(inits, states).collect()))
    by_state = I.seat_maps_of_states(inits, states).first()
    assert (by_state.seat_statuses, by_state.available_count) == (record.seat_statuses, 5)
    from_seats = [tuple(r) for r in I.free_runs(seats).collect()]
    from_states = [tuple(r) for r in I.free_runs_of_state(A.final_states(commands, inits)).collect()]
    assert from_seats == from_states == [(1, "A", 8, 5)]


def test_brute_force(spark):
    """The replay against a literal reading of the rules, seat by seat."""
    import random
    rng = random.Random(5)
    inits, requests = [], []
    for section in "ABCD":
        taken = [f"{section}-{n}" for n in rng.sample(range(1, 31), 8)]
        inits.append((1, section, 5, 6, taken))
    for i in range(120):
        requests.append((f"r{i:03}", 1, rng.choice("ABCDX"), rng.randrange(0, 6)))
    free = {s: [n for n in range(1, 31) if f"{s}-{n}" not in res] for _, s, _, _, res in inits}
    expected = {}
    for rid, _, section, n in requests:
        seats = free.get(section, [])
        fit = next((x for x in seats if n > 0 and all(x + k in seats for k in range(n))), None)
        expected[rid] = fit
        if fit is not None:
            free[section] = [x for x in seats if not fit <= x < fit + n]
    rows = A.allocate_seats(make_commands(spark, requests), make_inits(spark, inits)).collect()
    assert {r.reservation_id: r.first_seat for r in rows} == expected
