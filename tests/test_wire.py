"""Records as they travel: layouts, defaults, round trips; checks of requests."""

import datetime as dt

from pyspark.sql import functions as F

from parterre.operators import allocate as A
from parterre.operators.reports import check_report, request_checks
from parterre.sources import wire as W
from tests.conftest import START, make_commands, make_inits
from tests.test_streaming import rows


def test_round_trips(spark):
    inits = make_inits(spark, [(1, "A", 2, 3, ["A-2"]), (2, "B-x", 1, 0, [])])
    commands = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 9)]).withColumn("ts", F.col("ts") + F.expr("interval '0.123' second"))
    trip = lambda records, name: W.decoded(W.encoded(records, F.lit("k")), name)
    assert rows(W.from_commands(trip(W.to_commands(commands), "ReservationCommand"))) == rows(commands)
    assert rows(W.from_inits(trip(W.to_inits(inits), "SectionInitCommand"))) == rows(inits.drop("ts"))
    results = A.allocate_seats(commands, inits)
    done = W.from_completions(trip(W.to_completions(results), "ReservationCompletedEvent"))
    assert {(r.reservation_id, tuple(r.allocated_seats), r.completed_ts.microsecond) for r in done.collect()} == {
        ("r1", ("A-3", "A-4"), 123_000), ("r2", (), 123_000)}
    status = A.status_changelog(commands, inits).select("event_id", "section", "available_count", "status_ts")
    assert rows(W.from_statuses(trip(W.to_statuses(status), "SectionStatusEvent"))) == rows(status)
    states = A.final_states(commands, inits).select("event_id", "section", "available_count", "run_starts", "run_stops")
    seats = states.join(inits.select("event_id", "section", (F.col("rows") * F.col("seats_per_row")).alias("n")), ["event_id", "section"])
    assert rows(W.from_states(trip(W.to_states(seats, F.col("n")), "SectionSeatState"))) == rows(states)


def test_what_a_missing_field_counts_as(spark):
    values = spark.createDataFrame([('{"reservationId": "r", "eventId": 1, "userId": "u", "status": "REJECTED", "timestamp": 1}',)], "value string")
    row = W.from_completions(W.decoded(values, "ReservationCompletedEvent")).first()
    assert (row.section, row.seat_count, row.completed_ts) == ("", 0, dt.datetime(1970, 1, 1, 0, 0, 0, 1000))
    assert [f.name for f in W.layout("SectionInitCommand")] == ["eventId", "section", "rows", "seatsPerRow", "initialReserved"]
    assert START.microsecond == 0


def test_checks_of_requests(spark):
    log = spark.createDataFrame([(1, 202, 200, "CONFIRMED"), (2, 202, 200, "PENDING"), (3, 202, 504, None), (4, 503, 200, "CONFIRMED"), (5, None, None, None)],
                                "request_id long, post_status int, get_status int, status string")
    assert [(r.checks, r.passed) for r in request_checks(log).orderBy("request_id").collect()] == [(3, 3), (3, 2), (2, 1), (1, 0), (1, 0)]
    row = check_report(log).first()
    assert (row.requests, row.checks, row.passed, row.completed, row.pass_rate, row.get_rate, row.checks_ok) == (5, 10, 6, 2, 0.6, 2 / 3, False)
    assert check_report(log.limit(0)).first().pass_rate is None
