"""Streams end where the batch queries do, however the input is cut."""

import random

import pytest
from pyspark.sql import functions as F

from parterre.operators import allocate as A
from parterre.schemas import COMMAND, SECTION_INIT
from parterre.sources.files import publish, publish_stream, read_log
from parterre.streaming.follow import ChangedEvents, LatestTable, status_feed
from parterre.streaming.route import StreamingRoute, tagged
from tests.conftest import make_commands, make_inits


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def number(column="reservation_id"):
    return F.substring(column, 2, 9).cast("int")


@pytest.mark.parametrize("shed", [False, True])
def test_any_cut_gives_the_batch_result(spark, tmp_path, shed):
    rng = random.Random(8)
    inits = make_inits(spark, [(1, s, 2, 6, [f"{s}-5"]) for s in "AB"] + [(1, "A", 1, 3, [], 30)])
    commands = make_commands(spark, [(f"r{i:03}", 1, rng.choice("ABX"), rng.randrange(1, 4)) for i in range(60)])
    route = StreamingRoute(spark, str(tmp_path / "route"), shed=shed, buckets=2)
    cuts = [0, 7, 30, 31, 60]
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        publish(commands.where((number() >= a) & (number() < b)), str(tmp_path / "commands"))
        if step in (0, 2):
            at = F.second("ts") == (59 if step == 0 else 30)
            publish(inits.where(at), str(tmp_path / "inits"))
        route.run(read_log(spark, str(tmp_path / "commands"), COMMAND, stream=True),
                  read_log(spark, str(tmp_path / "inits"), SECTION_INIT, stream=True))
    wanted = A.allocate_seats(commands, inits)
    assert rows(route.completed().drop("epoch", "prefiltered")) == rows(wanted.drop("epoch"))
    assert rows(route.states()) == rows(A.final_states(commands, inits).drop("ts"))
    if not shed:
        assert rows(route.changelog()) == rows(A.status_changelog(commands, inits))


def test_a_batch_handed_over_twice_counts_once(spark, tmp_path):
    inits, commands = make_inits(spark, [(1, "A", 1, 5, [])]), make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 2)])
    route = StreamingRoute(spark, str(tmp_path / "route"))
    route.handle(tagged(commands, inits), 0)
    later = tagged(make_commands(spark, [("r3", 1, "A", 1, 9)]), inits.limit(0))
    route.handle(later, 1)
    route.handle(later, 1)
    assert [(r.reservation_id, r.first_seat) for r in route.completed().orderBy("reservation_id").collect()] == [
        ("r1", 1), ("r2", 3), ("r3", 5)]


def test_latest_table_and_changes(spark, tmp_path):
    schema = "reservation_id string, event_id bigint, status string, at int"
    table = LatestTable(spark, str(tmp_path / "table"), spark.createDataFrame([], schema).schema, ["reservation_id"], ["at"], buckets=2)
    changes = ChangedEvents(spark, str(tmp_path / "changes"))
    batches = [[("a", 1, "PENDING", 1), ("b", 2, "PENDING", 1)], [("a", 1, "confirmed", 2)],
               [("b", 2, "REJECTED", 2)], [("c", 3, "CONFIRMED", 1), ("a", 1, "LATE", 0)]]
    for batch in batches:
        publish(spark.createDataFrame(batch, schema), str(tmp_path / "in"))
        stream = read_log(spark, str(tmp_path / "in"), table.table.schema, stream=True)
        table.run(stream)
        changes.run(read_log(spark, str(tmp_path / "in"), table.table.schema, stream=True))
    assert {tuple(r) for r in table.read().collect()} == {
        ("a", 1, "confirmed", 2), ("b", 2, "REJECTED", 2), ("c", 3, "CONFIRMED", 1)}
    assert {(r.batch, r.event_id) for r in changes.read().collect()} == {(1, 1), (3, 3)}


def test_feed_of_one_event(spark, tmp_path):
    route = StreamingRoute(spark, str(tmp_path / "route"))
    inits = make_inits(spark, [(e, "A", 1, 4, []) for e in (1, 2)])
    for batch in range(2):
        commands = make_commands(spark, [(f"r{batch}{e}", e, "A", 1, batch) for e in (1, 2)])
        route.handle(tagged(commands, inits if batch == 0 else inits.limit(0)), batch)
        stream = route.sinks.stream("status").withColumnRenamed("ts", "status_ts")
        publish_stream(status_feed(stream, 2), str(tmp_path / "feed"), str(tmp_path / "feed-checkpoint"))
    feed = spark.read.parquet(str(tmp_path / "feed")).orderBy("status_ts").collect()
    assert [(r.event_id, r.available_count) for r in feed] == [(2, 4), (2, 3), (2, 2)]
