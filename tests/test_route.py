"""The batch route gives the result of one replay, however commands and set-ups are cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parterre.operators import allocate as A
from parterre.operators import integrity as V
from parterre.operators import route as RT
from parterre.operators.route import route_batch
from parterre.streaming.route import StreamingRoute, tagged
from tests.conftest import START, make_commands, make_inits


def outcomes(df):
    return {r.reservation_id: (r.status, r.first_seat, r.completed_ts) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_any_cut_of_several_set_ups(spark, seed):
    rng = random.Random(seed)
    inits = make_inits(spark, [(1, s, 1, rng.choice([2, 4, 9]), [], at) for s in "AB" for at in (-1, 20, 41)])
    commands = make_commands(spark, [(f"r{i:03}", 1, rng.choice("ABX"), rng.randrange(1, 4)) for i in range(60)])
    wanted = outcomes(A.allocate_seats(commands, inits))
    cuts = [-2, *sorted(rng.sample(range(60), 2)), 61]
    route, seen = RT.Route(), {}
    for a, b in zip(cuts, cuts[1:]):
        between = (F.col("ts") >= F.lit(START + dt.timedelta(seconds=a))) & (F.col("ts") < F.lit(START + dt.timedelta(seconds=b)))
        seen |= outcomes(route.run(commands.where(between), inits.where(between)))
    assert seen == wanted


def test_a_later_set_up_does_not_reach_back(spark):
    first, second = make_inits(spark, [(1, "A", 1, 2, [])]), make_inits(spark, [(1, "A", 1, 4, [], 10)])
    route = RT.Route()
    early = outcomes(route.run(make_commands(spark, [("r1", 1, "A", 2, 0), ("r2", 1, "A", 2, 5)]), first))
    late = outcomes(route.run(make_commands(spark, [("r3", 1, "A", 2, 20), ("r4", 1, "A", 2, 21)]), second))
    assert [v[:2] for v in (early | late).values()] == [("CONFIRMED", 1), ("REJECTED", None), ("CONFIRMED", 1), ("CONFIRMED", 3)]


def test_balance_after_a_second_set_up(spark):
    inits = make_inits(spark, [(1, "A", 1, 4, []), (1, "A", 1, 4, [], 5)])
    commands = make_commands(spark, [("r1", 1, "A", 2, 0), ("r2", 1, "A", 1, 6)])
    outcome = A.replay(commands, inits, with_states=True)
    states = A.states_of(outcome, F.lit(None).cast("timestamp_ntz"))
    [row] = V.inventory_balance(inits, A.results_of(outcome), states).collect()
    assert (row.total, row.available, row.reserved, row.kept_available, row.balanced) == (4, 3, 1, 3, True)
    [row] = V.inventory_balance(inits, A.results_of(outcome).where("reservation_id = 'r1'"), states).collect()
    assert not row.balanced


def test_a_seat_of_a_longer_section_name_is_a_violation(spark):
    rows = [("r1", "A", 1, "CONFIRMED", ["A-B-3"]), ("r2", "A-B", 1, "CONFIRMED", ["A-B-3"])]
    df = spark.createDataFrame(rows, "reservation_id string, section string, seat_count int, status string, allocated_seats array<string>")
    assert [(r.reservation_id, r.problem) for r in V.allocation_violations(df).collect()] == [("r1", "seat of another section")]


def test_states_before_any_batch_and_of_touched_buckets(spark, tmp_path):
    """A section's state is read from its own bucket."""
    route = StreamingRoute(spark, str(tmp_path / "route"), buckets=16)
    assert route.states().count() == 0
    sections = [(e, "A", 1, 5, []) for e in range(8)]
    route.handle(tagged(make_commands(spark, [("r1", 1, "A", 2)]), make_inits(spark, sections)), 0)
    one = route.kept.find(1, "A")
    assert one.count() == 1 and len(one.inputFiles()) == 1 and len(route.kept.read().inputFiles()) > 1
    before = route.kept.commits.get(0)
    route.handle(tagged(make_commands(spark, [("r2", 1, "A", 2, 9)]), make_inits(spark, sections).limit(0)), 1)
    assert [b for b, n in route.kept.commits.get(1).items() if n == 1] == [b for b in before if f"bucket={b}/" in one.inputFiles()[0]]
    assert route.states().where("event_id = 1").first().available_count == 1


def test_commands_are_exchanged_once(spark, tmp_path):
    """With no broadcast at all, commands reach the fold by one exchange; the states meet them there."""
    make_commands(spark, [("r1", 1, "A", 2)]).write.parquet(str(tmp_path / "commands"))
    inits = make_inits(spark, [(1, "A", 1, 5, [])])
    states = A.final_states(make_commands(spark, []), inits).drop("ts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outcome = route_batch(spark.read.parquet(str(tmp_path / "commands")), inits.limit(0), states)
        lines = outcome._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)|"))
    at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and "reservation_id" in line)
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert sum("Exchange" in line for line in above) == 1 and not any("Join" in line for line in above)
