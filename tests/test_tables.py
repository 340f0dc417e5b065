"""Lookups, ingest, reports and integrity checks on small planted inputs."""

import random

from pyspark.sql import functions as F

from parterre.operators import allocate as A
from parterre.operators import integrity as V
from parterre.operators import relational as R
from parterre.operators import reports as G
from parterre.operators import route as RT
from parterre.operators import tables as T
from tests.conftest import make_commands, make_inits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), ("b", 1, None)], "k string, at int, v string")
    assert {tuple(r) for r in T.latest_by_key(df, ["k"], ["at"]).collect()} == {("a", 3, "y"), ("b", 1, None)}


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "t"))
    found = T.find_by(spark.read.parquet(str(tmp_path / "t")), id=7)
    assert "EqualTo(id,7)" in plan(found)
    assert found.count() == 1


def test_lookup_keeps_requests_without_a_row(spark):
    asked = spark.createDataFrame([(1,), (9,), (1,)], "asked_id bigint")
    table = spark.createDataFrame([(1, "one")], "id bigint, name string")
    rows = T.lookup(asked, table, "id", "asked_id").collect()
    assert sorted((r.asked_id, r.name or "", r.found) for r in rows) == [(1, "one", True), (1, "one", True), (9, "", False)]


def test_two_reads_of_a_reservation_agree(spark):
    inits = make_inits(spark, [(1, "A", 1, 5, [])])
    table = A.with_seat_names(A.allocate_seats(make_commands(spark, [("r1", 1, "A", 2)]), inits))
    one, two = (T.find_by(table, reservation_id="r1").collect() for _ in range(2))
    assert one == two and one[0].allocated_seats == ["A-1", "A-2"]
    assert T.find_by(table, reservation_id="r2").collect() == []


def test_prefilter_rules(spark):
    status = spark.createDataFrame([(1, "A", 2), (1, "B", 3)], "event_id bigint, section string, available_count int")
    commands = make_commands(spark, [("unknown", 9, "Z", 4), ("equal", 1, "A", 2), ("above", 1, "A", 3), ("below", 1, "B", 1)])
    kept, refused = RT.prefilter(commands, status)
    assert {r.reservation_id for r in kept.collect()} == {"unknown", "equal", "below"}
    assert [(r.reservation_id, r.status, r.first_seat) for r in refused.collect()] == [("above", "REJECTED", None)]


def test_prefilter_does_not_change_outcomes(spark):
    rng = random.Random(3)
    inits = make_inits(spark, [(1, s, 3, 5, [f"{s}-4"]) for s in "AB"])
    commands = make_commands(spark, [(f"r{i:03}", 1, rng.choice("AB"), rng.randrange(1, 5)) for i in range(60)])
    route = RT.Route()
    cuts = [0, 10, 25, 60]
    parts = [commands.where(f"cast(substr(reservation_id, 2) as int) >= {a} and cast(substr(reservation_id, 2) as int) < {b}")
             for a, b in zip(cuts, cuts[1:])]
    seen = {}
    early = 0
    for part in parts:
        for r in route.run(part, None if seen else inits).collect():
            seen[r.reservation_id] = (r.status, r.first_seat)
            early += r.prefiltered
    plain = {r.reservation_id: (r.status, r.first_seat) for r in A.allocate_seats(commands, inits).collect()}
    assert seen == plain
    assert early > 0


def test_ingest_splits(spark, tmp_path):
    events = spark.createDataFrame([(1,)], "id bigint")
    tickets = R.ticket_records(spark.createDataFrame([(1, 1, "A-1", 5.0), (2, 7, "A-2", 5.0)],
                                                     "id bigint, event_id bigint, seat_number string, price double"))
    checked = R.check_parent(tickets, events, "event_id").withColumn("verdict", R.verdict(F.col("parent_known")))
    R.ingest(checked.drop("parent_known"), str(tmp_path / "t"), str(tmp_path / "refused"))
    assert [(r.id, r.status) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, "AVAILABLE")]
    assert [(r.id, r.verdict) for r in spark.read.parquet(str(tmp_path / "refused")).collect()] == [(2, "unknown parent")]


def test_planted_faults_are_reported(spark):
    rows = [("ok", "CONFIRMED", 2, ["A-1", "A-2"]), ("few", "CONFIRMED", 3, ["A-3", "A-4"]),
            ("gap", "CONFIRMED", 2, ["A-5", "A-7"]), ("alien", "CONFIRMED", 1, ["B-1"]),
            ("kept", "REJECTED", 1, ["A-9"]), ("no", "REJECTED", 1, []), ("odd", "PENDING", 1, None)]
    df = spark.createDataFrame([(i, "A", s, n, seats) for i, s, n, seats in rows],
                               "reservation_id string, section string, status string, seat_count int, allocated_seats array<string>")
    assert {r.reservation_id for r in V.allocation_violations(df).collect()} == {"few", "gap", "alien", "kept", "odd"}
    inits = make_inits(spark, [(1, "A", 1, 6, [])])
    commands = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 3)])
    results = A.allocate_seats(commands, inits)
    copied = results.where("reservation_id = 'r2'").withColumn("reservation_id", F.lit("r9"))
    assert sorted(r.seat_no for r in V.duplicate_seats(results.unionByName(copied)).collect()) == [3, 4, 5]
    assert V.duplicate_seats(results).count() == 0
    assert [r.reservation_id for r in V.unresolved_commands(commands, results.where("reservation_id = 'r1'")).collect()] == ["r2"]
    states = A.final_states(commands, inits)
    assert V.inventory_balance(inits, results, states).first().balanced
    lost = V.inventory_balance(inits, results.where("reservation_id = 'r1'"), states).first()
    assert (lost.available, lost.kept_available, lost.balanced) == (4, 1, False)


def test_exact_percentiles_across_bins(spark):
    rng = random.Random(1)
    data = [rng.randrange(0, 10_000) for _ in range(501)] + [7] * 300
    df = spark.createDataFrame([(v,) for v in data], "ms bigint")
    points = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = {r.point: r.milliseconds for r in G.exact_percentiles(df, ["ms"], points).collect()}
    want = df.select(F.percentile("ms", points)).first()[0]
    assert [round(got[p], 6) for p in points] == [round(w, 6) for w in want]


def test_latency_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "post_ms bigint, get_ms bigint, latency_ms bigint, ok boolean")
    assert G.latency_percentiles(empty).count() == 0
    assert G.slo_report(empty).first().requests == 0


def test_sections_of_tickets(spark):
    df = spark.createDataFrame([(1, "A-1", "AVAILABLE"), (1, "A-2", "SOLD"), (1, "B-1", "RESERVED")],
                               "event_id bigint, seat_number string, status string")
    rows = {r.section: (r.rows, r.seats_per_row, r.initial_reserved) for r in R.sections_of_tickets(df).collect()}
    assert rows == {"A": (1, 2, ["A-2"]), "B": (1, 1, ["B-1"])}
