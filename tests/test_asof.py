"""As-of joins against a plain search, in both forms; ingest that can be repeated."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.operators import allocate as A
from parterre.operators import relational as R
from parterre.operators import route as RT
from parterre.operators.asof import as_of_join
from parterre.operators.compat import resolve_event_names_as_of
from tests.conftest import make_commands, make_inits

LEFT, RIGHT = "k string, at int, name string", "k string, since int, v int, rank int"


def plain(left, right, before):
    out = []
    for k, at, name in left:
        seen = [r for r in right if None not in (k, at, r[0], r[1]) and r[0] == k and (r[1] < at if before else r[1] <= at)]
        last = max(seen, key=lambda r: (r[1], r[3]), default=(None,) * 4)
        out.append((k, at, name, last[2], last[1]))
    return sorted(out, key=str)


def made(rng, n):
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(key(), rng.choice([None, *range(30)]), rng.choice(["x", "y"])) for _ in range(n)]
    right = [(key(), rng.choice([None, *range(0, 30, 3)]), rng.choice([None, 1, 2, 3]), i) for i in range(n)]
    return left, right


def check(spark, before):
    left, right = made(random.Random(4), 80)
    found = as_of_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "at", "since", ["v", "since"],
                       before=before, ties=["rank"])
    assert found.columns == ["k", "at", "name", "v", "since"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(left, right, before)


@pytest.mark.parametrize("before", [False, True])
def test_as_of(spark, before):
    check(spark, before)


@pytest.mark.parametrize("before", [False, True])
def test_as_of_with_hot_keys(spark, tiny_tasks, before):
    check(spark, before)


def test_as_of_has_one_exchange_a_side(spark):
    left, right = (spark.range(5).select(F.col("id").alias("k"), F.col("id").alias(t), F.lit(1).alias(v)) for t, v in (("at", "x"), ("since", "v")))
    joined = as_of_join(left, right, ["k"], "at", "since", ["v"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_as_of_nothing(spark):
    left = spark.createDataFrame([("a", 1, "x")], LEFT)
    none = spark.createDataFrame([], RIGHT)
    assert as_of_join(left, none, ["k"], "at", "since", ["v"]).first().v is None
    assert as_of_join(left.limit(0), none, ["k"], "at", "since", ["v"]).count() == 0


def test_names_as_registered_at_the_time(spark):
    registered = spark.createDataFrame([("rock", 1, 10), ("rock", 2, 20), ("rock", 3, 20)], "event_name string, event_id long, registered_ts int")
    asked = spark.createDataFrame([("rock", 9), ("rock", 10), ("rock", 19), ("rock", 20), ("jazz", 50)], "event_name string, ts int")
    found = resolve_event_names_as_of(asked, registered).orderBy("ts").collect()
    assert [r.event_id for r in found] == [None, 1, 1, 3, None]


def test_status_as_it_stood(spark):
    inits = make_inits(spark, [(1, "A", 1, 5, [])])
    commands = make_commands(spark, [("r1", 1, "A", 2), ("r2", 1, "A", 9), ("r3", 1, "A", 1), ("r4", 1, "B", 1)])
    found = RT.with_status_as_of(commands, A.status_changelog(commands, inits)).orderBy("ts").collect()
    assert [r.known_available for r in found] == [5, 3, 3, None]


def test_ingest_again_leaves_the_tables_as_they_are(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
    frame = lambda data: spark.createDataFrame(data, "id long, status string, verdict string")
    folder = str(tmp_path / "in")
    taken = lambda accepted=True: sorted(tuple(r) for r in R.ingested(spark, folder, schema, accepted).collect())
    for _ in range(2):
        R.ingest_batch(frame([(1, "a", "accepted"), (2, "b", "unknown parent"), (3, "c", None)]), folder, "2024/01 first")
    R.ingest_batch(frame([(4, "d", "accepted")]), folder, "second")
    assert taken() == [(1, "a"), (4, "d")]
    assert sorted(map(str, taken(False))) == ["(2, 'b', 'unknown parent')", "(3, 'c', None)"]
    # what was accepted is refused now: the earlier acceptance goes
    R.ingest_batch(frame([(4, "d", "unknown parent")]), folder, "second")
    assert taken() == [(1, "a")]
    plan = R.ingested(spark, folder, schema)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accepted" in plan


def test_ingest_evaluates_its_input_once(spark, tmp_path):
    drawn = spark.range(200).select("id", F.when(F.rand() < 0.5, "accepted").otherwise("invalid status").alias("verdict"))
    R.ingest(drawn, str(tmp_path / "t"), str(tmp_path / "refused"))
    ids = [r.id for name in ("t", "refused") for r in spark.read.parquet(str(tmp_path / name)).collect()]
    assert sorted(ids) == list(range(200))
