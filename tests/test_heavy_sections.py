"""The spread form of a hot section gives what the single-task fold gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parterre import schemas
from parterre.operators import allocate as A
from parterre.operators import route as RT
from parterre.operators.running import sequence_number
from parterre.session import HEAVY_KEY_ROWS, SINGLE_TASK_BYTES
from tests.conftest import START, make_commands, make_inits


def random_case(spark, seed):
    rng = random.Random(seed)
    inits, commands = [], []
    for section, share in [("HOT", 120), ("B", 12), ("NONE", 9), ("C", 3)]:
        if section != "NONE":
            for at in [-1] + ([rng.randrange(0, 60) for _ in range(3)] if section == "HOT" else []):
                total = rng.choice([0, 6, 25])
                reserved = [f"{section}-{n}" for n in rng.sample(range(1, 26), 5)]
                inits.append((1, section, 1, total, reserved, START + dt.timedelta(seconds=at)))
        for n in range(share):
            row = (f"r{rng.randrange(200)}", 1, section, rng.choice([-1, 0, 1, 1, 2, 3, 4, 9]), "u",
                   START + dt.timedelta(seconds=rng.randrange(0, 60)))
            commands.extend([row] * rng.choice([1, 1, 1, 4]))   # at-least-once copies
    return (spark.createDataFrame(commands, schemas.COMMAND).repartition(3),
            spark.createDataFrame(inits, schemas.SECTION_INIT))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def both_ways(spark, build):
    plain = rows(build())
    spark.conf.set(HEAVY_KEY_ROWS[0], "10")
    spark.conf.set(SINGLE_TASK_BYTES[0], "0")
    try:
        spread = rows(build())
    finally:
        spark.conf.unset(HEAVY_KEY_ROWS[0])
        spark.conf.unset(SINGLE_TASK_BYTES[0])
    return plain, spread


@pytest.mark.parametrize("seed", range(2))
def test_results_status_and_states_agree(spark, seed):
    commands, inits = random_case(spark, seed)
    for build in (
        lambda: A.allocate_seats(commands, inits),
        lambda: A.status_changelog(commands, inits),
        lambda: A.final_states(commands, inits),
    ):
        plain, spread = both_ways(spark, build)
        assert plain == spread
        assert plain


def test_carried_states_in_a_hot_section(spark):
    commands, inits = random_case(spark, 11)
    early = commands.where(F.col("ts") < F.lit(START + dt.timedelta(seconds=30)))
    late = commands.where(F.col("ts") >= F.lit(START + dt.timedelta(seconds=30)))
    first_inits = inits.where(F.col("ts") < F.lit(START))
    states = A.states_of(A.replay(early, first_inits, with_states=True),
                         F.lit(START + dt.timedelta(seconds=29)))
    plain, spread = both_ways(
        spark, lambda: A.results_of(A.replay(late, inits.limit(0), states)))
    assert plain == spread
    whole = A.allocate_seats(commands, first_inits).where(
        F.col("completed_ts") >= F.lit(START + dt.timedelta(seconds=30)))
    assert plain == rows(whole)


def test_sequence_numbers_with_copies(spark):
    commands = make_commands(spark, [(f"r{i % 4}", 1, "A", 1, 0) for i in range(40)]
                             + [(f"x{i}", 2, "B", 1) for i in range(5)]).repartition(3)
    order = ["ts", "reservation_id"]
    plain, spread = both_ways(spark, lambda: sequence_number(commands, ["event_id", "section"], order, "n"))
    assert plain == spread


def test_only_as_many_requests_as_seats_reach_the_fold(spark, tiny_tasks):
    inits = make_inits(spark, [(1, "A", 1, 4, [])])
    commands = make_commands(spark, [(f"r{i:03}", 1, "A", 1 + i % 2) for i in range(200)])
    out = A.allocate_seats(commands, inits)
    assert out.count() == 200
    assert out.where("status = 'CONFIRMED'").agg(F.sum("seat_count")).first()[0] == 4


def test_the_fold_keeps_its_own_shuffle(spark):
    """After a join on the section, adaptive execution may split what it thinks is
    a skewed partition; the fold must still see every section whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200b",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    inits = make_inits(spark, [(1, s, 10, 10, []) for s in "ABCD"])
    commands = make_commands(spark, [(f"r{i:03}", 1, "AAABCD"[i % 6], 1 + i % 3) for i in range(240)]).repartition(8)
    wanted = rows(A.allocate_seats(commands, inits))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        status = inits.select("event_id", "section", F.lit(10**6).alias("available_count")).distinct()
        kept = RT.accepted(RT.with_verdict(commands, status))
        assert rows(A.allocate_seats(kept, inits.dropDuplicates(["event_id", "section"]))) == wanted
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
