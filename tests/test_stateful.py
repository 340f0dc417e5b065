"""The stateful operator ends where the batch replay does; sinks and bucketed tables survive half-written batches."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from parterre.operators import allocate as A
from parterre.operators.route import BEFORE_ALL
from parterre.schemas import COMMAND, SECTION_INIT
from parterre.sources.files import publish, read_log
from parterre.streaming.sinks import ROUTE_KEYS, route_sinks, send_route
from parterre.streaming.stateful import StatefulRoute, first_of_each_size
from parterre.streaming.upsert import BucketedTable
from tests.conftest import make_commands, make_inits
from tests.test_streaming import number, rows


def fed(spark, folder, route, commands, inits, cuts, init_steps):
    """Commands cut into runs of the stream, each with the set-ups of ``init_steps``."""
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        publish(commands.where((number() >= a) & (number() < b)), f"{folder}/commands")
        publish(inits.where(F.second("ts").isin(init_steps.get(step, []))), f"{folder}/inits")
        route.run(read_log(spark, f"{folder}/commands", COMMAND, stream=True), read_log(spark, f"{folder}/inits", SECTION_INIT, stream=True))


@pytest.mark.parametrize("most_rows", [100_000, 4])
def test_stateful_equals_batch(spark, tmp_path, most_rows):
    """With ``most_rows`` 4 nearly all requests are spilled; the second set-up of A falls into a batch with spilled rows."""
    rng = random.Random(8)
    inits = make_inits(spark, [(1, s, 2, 6, [f"{s}-5"]) for s in "AB"] + [(1, "A", 1, 3, [], 30)])
    commands = make_commands(spark, [(f"r{i:03}", 1, rng.choice("AABX"), rng.randrange(0, 4)) for i in range(60)])
    route = StatefulRoute(spark, str(tmp_path / "route"), most_rows=most_rows)
    fed(spark, tmp_path, route, commands, inits, [0, 7, 60], {0: [59], 1: [30]})
    assert rows(route.completed().drop("prefiltered")) == rows(A.allocate_seats(commands, inits))
    assert rows(route.changelog()) == rows(A.status_changelog(commands, inits))
    assert rows(route.states()) == rows(A.final_states(commands, inits).drop("ts"))


def test_initial_state_and_shedding(spark, tmp_path):
    inits = make_inits(spark, [(1, "A", 1, 5, []), (1, "B", 1, 2, [])])
    early = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "B", 2)])
    late = make_commands(spark, [("r3", 1, "A", 4, 5), ("r4", 1, "A", 2, 6), ("r5", 1, "A", 2, 7), ("r6", 1, "B", 1, 8), ("r7", 1, "C", 1, 9)])
    route = StatefulRoute(spark, str(tmp_path / "route"), shed=True, initial=A.final_states(early, inits), most_rows=1)
    fed(spark, tmp_path, route, late, inits.limit(0), [0, 9], {})
    found = {r.reservation_id: (r.status, r.first_seat, r.prefiltered, r.epoch) for r in route.completed().collect()}
    assert found == {"r3": ("REJECTED", None, True, None), "r4": ("CONFIRMED", 3, False, 1), "r5": ("REJECTED", None, False, 1),
                     "r6": ("REJECTED", None, True, None), "r7": ("REJECTED", None, False, 0)}
    # the batch form goes on from the stream's states
    more = make_commands(spark, [("r8", 1, "A", 1, 20)])
    carried = route.states().withColumn("ts", F.expr(BEFORE_ALL))
    assert A.results_of(A.replay(more, inits.limit(0), carried)).first().first_seat == 5


def test_what_may_be_served():
    requests = [(t, "r", n, "u") for t, n in enumerate([2, 0, 2, 3, 2, 9, 2])]
    kept, others = first_of_each_size(requests, [4, 9], [5])
    assert [r[0] for r in kept] == [0, 2, 3, 5, 6]
    assert sorted(kept + others) == requests


def outcome_of(spark):
    inits = make_inits(spark, [(1, "A", 1, 4, [])])
    commands = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 3), ("r3", 1, "X", 1)])
    return A.replay(commands, inits, with_status=True).withColumn("prefiltered", F.col("reservation_id") == "r2")


def test_sinks_of_one_batch(spark, tmp_path):
    sinks = route_sinks(spark, str(tmp_path / "sinks"))
    assert sinks.read("results").count() == 0
    for _ in range(2):
        send_route(sinks, outcome_of(spark), 0)
    ids = lambda sink: sorted(str(r.asDict().get("reservation_id")) for r in sinks.read(sink).collect())
    assert {s: ids(s) for s in ROUTE_KEYS} == {
        "requests": ["r1", "r3"], "results": ["r1", "r3"], "completed": ["r1", "r2", "r3"], "states": [], "status": ["None", "r1"]}
    feed = {s: {(r.key, "reservation_id" in r.value) for r in sinks.records(s, ROUTE_KEYS[s]()).collect()} for s in ROUTE_KEYS}
    assert feed["completed"] == {("r1", True), ("r2", True), ("r3", True)} and feed["status"] == {("1-A", True), ("1-A", False)}


def test_a_failure_between_two_sinks(spark, tmp_path, monkeypatch):
    """Some sinks of batch 1 are there when its job fails: nobody sees them, and the retry writes all of them once."""
    sinks = route_sinks(spark, str(tmp_path / "sinks"))
    send_route(sinks, outcome_of(spark), 0)
    monkeypatch.setattr(sinks.commits, "put", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        send_route(sinks, outcome_of(spark), 1)
    monkeypatch.undo()
    written = tmp_path / "sinks/data/batch=1"
    shutil.rmtree(written / "sink=completed")
    os.remove(written / "_SUCCESS")
    assert os.path.isdir(written / "sink=status") and sinks.read("status").count() == 2
    send_route(sinks, outcome_of(spark), 1)
    assert sinks.read("completed").count() == 6 and sinks.read("status", first=1).count() == 2


def test_a_failure_before_the_commit(spark, tmp_path, monkeypatch):
    """Batch 0 is whole on disk but not committed: the retry leaves the files alone, for the streams that read them."""
    sinks = route_sinks(spark, str(tmp_path / "sinks"))
    monkeypatch.setattr(sinks.commits, "put", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        send_route(sinks, outcome_of(spark), 0)
    monkeypatch.undo()
    assert sinks.read("completed").count() == 0
    before = sorted(map(str, (tmp_path / "sinks/data").rglob("*.parquet")))
    send_route(sinks, outcome_of(spark), 0)
    assert sorted(map(str, (tmp_path / "sinks/data").rglob("*.parquet"))) == before and sinks.read("completed").count() == 3


def test_upsert_touches_the_buckets_of_its_keys(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v int, at int").schema
    table = BucketedTable(spark, str(tmp_path / "t"), schema, ["k"], ["at"], buckets=8)
    frame = lambda data: spark.createDataFrame(data, schema)
    table.upsert(frame([(f"k{i}", i, 1) for i in range(50)] + [("k1", -1, 0), (None, 7, 1)]), 0)
    table.upsert(frame([("k1", 100, 2), ("k2", 0, 0)]).where("k = 'k1'"), 1)
    table.upsert(frame([("k1", 999, 3)]), 1)  # handed over again: already committed
    assert len(os.listdir(tmp_path / "t/data/batch=1")) - len([n for n in os.listdir(tmp_path / "t/data/batch=1") if not n.startswith("bucket")]) == 1
    found = {r.k: r.v for r in table.read().collect()}
    assert found == {f"k{i}": i for i in range(50)} | {"k1": 100, None: 7}
    assert {r.k: r.v for r in table.as_of(0).collect()}["k1"] == 1 and table.as_of(-1).count() == 0
    one = table.find("k1")
    assert [(r.k, r.v) for r in one.collect()] == [("k1", 100)] and len(one.inputFiles()) == 1
    assert table.find("nobody").count() == 0
    assert {r.k for r in table.match(spark.createDataFrame([("k3",), ("k9",), ("zz",)], "k string")).collect()} == {"k3", "k9"}
    table.upsert(frame([("new", 1, 1)]), 2)
    table.vacuum(keep=1)
    assert table.commits.batches() == [2] and table.read().count() == 52


def test_half_an_upsert_does_not_count(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k string, at int").schema
    table = BucketedTable(spark, str(tmp_path / "t"), schema, ["k"], ["at"], buckets=4)
    table.upsert(spark.createDataFrame([("a", 1)], schema), 0)
    monkeypatch.setattr(table.commits, "put", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(spark.createDataFrame([("a", 5), ("b", 5)], schema), 1)
    monkeypatch.undo()
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    table.upsert(spark.createDataFrame([("a", 2)], schema), 1)
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]
