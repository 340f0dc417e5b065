"""Repeated requests, alerts, the history and stored sketches, in batch and as streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parterre.operators import sketches as K
from parterre.operators.dedup import repeated_requests
from parterre.schemas import COMMAND
from parterre.sources.files import publish, read_log
from parterre.sources.history import History
from parterre.streaming.alerts import Alerts, alert_windows
from parterre.streaming.dedup import RepeatedRequests
from tests.conftest import START


def requests(spark, rows):
    """``rows`` are (id, user, minute)."""
    return spark.createDataFrame([(i, 1, "A", 1, u, START + dt.timedelta(minutes=m)) for i, u, m in rows], COMMAND)


def plain(rows):
    last, out = {}, set()
    for i, u, m in sorted(rows, key=lambda r: (r[2], r[0])):
        if u not in last or m - last[u][0] >= 60:
            last[u] = (m, i)
        out.add((i, last[u][1] == i, last[u][1]))
    return out


def judged(df):
    return {(r.reservation_id, r.accepted, r.answered_by) for r in df.collect()}


def made(n):
    rng = random.Random(6)
    return [(f"r{k:03}", rng.choice(["u", "u", "u", "v", "w"]), rng.randrange(0, 900)) for k in range(n)]


@pytest.mark.parametrize("batch_rows", ["10000", "7"])
def test_repeats(spark, batch_rows):
    """Also where a key's rows come in several Arrow batches."""
    rows = made(120) + [("a", "x", 0), ("b", "x", 59), ("c", "x", 60), ("d", "x", 119), ("e", "x", 120), ("f", "y", 5), ("g", "y", 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        assert judged(repeated_requests(requests(spark, rows))) == plain(rows)
        assert repeated_requests(requests(spark, rows).limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_on_a_stream(spark, tmp_path):
    """Two runs, resumed; by the second one the watermark has passed some states' time."""
    rows = made(80)
    stream = RepeatedRequests(spark, str(tmp_path / "s"))
    for low, high in ((0, 300), (300, 900)):
        publish(requests(spark, [r for r in rows if low <= r[2] < high]), str(tmp_path / "in"))
        stream.run(read_log(spark, str(tmp_path / "in"), COMMAND, stream=True))
    assert judged(stream.read()) == plain(rows)
    assert stream.sinks.read("accepted").where("not accepted").count() == 0


LOG = "ts timestamp_ntz, latency_ms long, ok boolean"


def log(spark, rows):
    """``rows`` are (second, ms, ok)."""
    return spark.createDataFrame([(START + dt.timedelta(seconds=s), ms, ok) for s, ms, ok in rows], LOG)


def raised(df):
    return {((r.window_start - START).seconds, r.requests, r.timeouts, r.alert, r.severity) for r in df.collect()}


def test_alerts(spark, tmp_path):
    rows = [(s, 10, True) for s in range(0, 60, 3)] + [(5, 10, False)] + [(60, 10, False), (61, 10, True)] + [(120 + s, 90, True) for s in range(3)] + [(190, 5, None)]
    want = {(60, 2, 1, "HighTimeoutRate", "critical"), (120, 3, 0, "Slowdown", "warning"), (180, 1, 1, "HighTimeoutRate", "critical")}
    assert raised(alert_windows(log(spark, rows))) == want
    alerts = Alerts(spark, str(tmp_path / "a"), late="30 seconds")
    # the second run brings a row that is late but within the delay, and one for a window that is over
    for part in ([r for r in rows if r[0] < 121], [(r[0], r[1], r[2]) for r in rows if r[0] >= 121] + [(119, 10, True), (1, 900, False)], [(400, 1, True)]):
        publish(log(spark, part), str(tmp_path / "in"))
        alerts.run(read_log(spark, str(tmp_path / "in"), log(spark, rows).schema, stream=True))
    assert raised(alerts.read()) == (want - {(60, 2, 1, "HighTimeoutRate", "critical")}) | {(60, 3, 1, "HighTimeoutRate", "critical")}


def test_history(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, completed_ts timestamp_ntz").schema
    history = History(spark, str(tmp_path / "h"), schema)
    rows = lambda ids, day: spark.createDataFrame([(i, START + dt.timedelta(days=day, hours=i % 24)) for i in ids], schema)
    history.append(rows(range(5), 0).unionByName(rows(range(5, 8), 50)), "one")
    history.append(rows(range(8, 10), 0), "two")
    assert history.archive(dt.date(2024, 4, 5)) == [dt.date(2024, 1, 1)] and history.archive(dt.date(2024, 4, 5)) == []
    for _ in range(2):  # again, into days of which one is archived
        history.append(rows(range(5), 0).unionByName(rows(range(5, 8), 50)), "one")
    assert {(r.id, r.archived) for r in history.read().collect()} == {(i, i not in (5, 6, 7)) for i in range(10)} and history.read().count() == 10
    assert history.read(archived=False).count() == 3
    some = history.read(dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert some.count() == 3 and len(some.inputFiles()) == len(history.read(archived=False).inputFiles())
    assert "day#" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_sketches_merge_over_any_hours(spark):
    rng = random.Random(1)
    rows = [(START + dt.timedelta(hours=rng.randrange(20)), rng.randrange(100_000) if rng.random() < 0.5 else 7, None) for _ in range(40_000)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, ms int, none int")
    sketches = K.hourly_sketches(frame, {"ms": F.col("ms"), "none": F.col("none")})
    assert sketches.count() == 20
    for low, high in ((0, 20), (3, 4), (5, 12)):
        hours = lambda c: (F.col(c) >= F.lit(START + dt.timedelta(hours=low)).cast("timestamp_ntz")) & (
            F.col(c) < F.lit(START + dt.timedelta(hours=high)).cast("timestamp_ntz"))
        found = K.merged_percentiles(sketches.where(hours("hour")), [0.1, 0.5, 0.95, 0.99])
        inside = frame.where(hours("ts")).select(F.lit("ms").alias("measure"), F.col("ms").alias("value"))
        checked = K.rank_errors(inside, found).collect()
        assert len(checked) == 4 and all(r.rank_error <= K.RANK_ERROR and r.n == inside.count() for r in checked)
