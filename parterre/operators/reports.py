"""Outcome, seat and latency reports of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parterre.operators.allocate import seats_taken
from parterre.schemas import CONFIRMED, REJECTED, SECTION
from parterre.session import materialize


def outcome_counts(results: DataFrame) -> DataFrame:
    """Successful, failed and erroneous requests; ``ok`` is false on an error."""
    done = F.col("ok")
    confirmed = F.col("status") == CONFIRMED
    return results.agg(
        F.count_if(done & confirmed).alias("successful"),
        F.count_if(done & ~confirmed).alias("failed"),
        F.count_if(~done).alias("errors"))


def seats_per_section(results: DataFrame) -> DataFrame:
    """Distinct seats reserved per section, per event, and over all; a section without any counts 0.

    Seats are made distinct once; the three levels only add up counts.
    """
    sold = seats_taken(results).select(*SECTION, "seat_no").distinct().groupBy(*SECTION).agg(F.count(F.lit(1)).alias("seats"))
    asked = results.select(*SECTION).distinct().withColumn("seats", F.lit(0).cast("bigint"))
    per_section = sold.unionByName(asked)
    return per_section.rollup(*SECTION).agg(
        F.sum("seats").alias("seats"), F.grouping_id().cast("int").alias("level"))


_BINS = 4096


def exact_percentiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Interpolated percentiles of whole-number columns: one row per (column, point).

    The value at rank ``(n - 1) * p``, linear between neighbours. No task sees
    all values: the range is cut into at most 4,096 bins, whose counts locate the
    two neighbouring ranks, and only the distinct values of those bins are ranked.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in columns]))
    values = df.select(pairs.alias("m")).select("m.*").where("value is not null")
    # One scan: the steps below read the counts of distinct values, written once.
    counts = materialize(values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    width = (F.floor((F.max("value") - F.min("value")) / _BINS) + 1).alias("width")
    # One row per measure.
    ranges = counts.groupBy("measure").agg(F.min("value").alias("least"), width)
    counts = counts.join(F.broadcast(ranges), "measure").select(
        "measure", "value", "n", F.floor((F.col("value") - F.col("least")) / F.col("width")).alias("bin"))

    def ranged(rows: DataFrame, keys: list[str], by: str, base: str | None = None) -> DataFrame:
        through = F.sum("n").over(Window.partitionBy(*keys).orderBy(by))
        if base:
            through = through + F.col(base)
        return rows.withColumn("through", through).withColumn("before", F.col("through") - F.col("n"))

    bins = ranged(counts.groupBy("measure", "bin").agg(F.sum("n").alias("n")), ["measure"], "bin")
    totals = bins.groupBy("measure").agg(F.sum("n").alias("total"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    ranks = totals.withColumn("point", asked).withColumn("rank", (F.col("total") - 1) * F.col("point"))
    sides = F.explode(F.array(
        F.struct(F.floor("rank").alias("position"), (F.floor("rank") + 1 - F.col("rank")).alias("weight")),
        F.struct((F.floor("rank") + 1).alias("position"), (F.col("rank") - F.floor("rank")).alias("weight"))))
    targets = ranks.select("measure", "point", sides.alias("t")).select("measure", "point", "t.*").where("weight > 0")
    # Few rows: one per measure, point and neighbour.
    small = F.broadcast(targets)
    holds = (F.col("position") >= F.col("before")) & (F.col("position") < F.col("through"))
    hit_bins = bins.withColumnRenamed("measure", "m").join(
        small, (F.col("m") == F.col("measure")) & holds).select(
        "measure", "bin", F.col("before").alias("base")).distinct()
    near = ranged(counts.join(F.broadcast(hit_bins), ["measure", "bin"]), ["measure", "bin"], "value", "base")
    found = near.withColumnRenamed("measure", "m").join(small, (F.col("m") == F.col("measure")) & holds)
    return found.groupBy("measure", "point").agg(F.sum(F.col("value") * F.col("weight")).alias("milliseconds"))


def latency_percentiles(log: DataFrame) -> DataFrame:
    """P50, P95 and P99 of processing time and of latency, ranked separately, over requests that ended without error."""
    timed = log.where("ok").select((F.col("post_ms") + F.col("get_ms")).alias("processing_ms"), "latency_ms")
    return exact_percentiles(timed, ["processing_ms", "latency_ms"], [0.5, 0.95, 0.99])


# The thresholds of the load tests, as (P95 of POST in ms, P95 of GET in ms, least rate of checks passed).
THRESHOLDS = {"sustained": (500, 5_000, 0.99), "large": (500, 10_000, 0.95)}


def slo_report(log: DataFrame, thresholds: tuple[int, int, float] = THRESHOLDS["sustained"]) -> DataFrame:
    """Check rate, completed requests, durations of completed ones, thresholds met."""
    post_most, get_most, least_rate = thresholds
    done = F.col("ok")
    duration = F.when(done, F.col("latency_ms"))
    measures = log.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(done).alias("completed"),
        F.avg(done.cast("double")).alias("pass_rate"), F.avg(duration).alias("avg_duration_ms"),
        F.max(duration).alias("max_duration_ms"))
    measures = measures.select([F.col(c).cast("double") for c in measures.columns]).unpivot(
        [], measures.columns, "measure", "value")
    p95 = exact_percentiles(log.select("post_ms", "get_ms", duration.alias("duration_ms")),
                            ["post_ms", "get_ms", "duration_ms"], [0.95])
    every = measures.unionByName(p95.select(
        F.concat(F.lit("p95_"), "measure").alias("measure"), F.col("milliseconds").alias("value")))
    pick = lambda name: F.max(F.when(F.col("measure") == name, F.col("value")))
    row = every.agg(
        pick("requests").cast("bigint").alias("requests"), pick("completed").cast("bigint").alias("completed"),
        pick("pass_rate").alias("pass_rate"), pick("avg_duration_ms").alias("avg_duration_ms"),
        pick("max_duration_ms").cast("bigint").alias("max_duration_ms"),
        *[pick(f"p95_{c}").alias(f"p95_{c}") for c in ["post_ms", "get_ms", "duration_ms"]])
    return row.select(
        "*", (F.col("p95_post_ms") < post_most).alias("post_ok"),
        (F.col("p95_get_ms") < get_most).alias("get_ok"),
        (F.col("pass_rate") > least_rate).alias("checks_ok"))


def request_checks(log: DataFrame) -> DataFrame:
    """How many checks each request ran, and how many of them passed.

    ``log`` has (request_id, post_status, get_status, status). A request is asked for its outcome only if it was taken
    (202), and its outcome is looked at only if it came (200); so a request runs one to three checks.
    """
    taken = F.coalesce(F.col("post_status") == 202, F.lit(False))
    answered = taken & F.coalesce(F.col("get_status") == 200, F.lit(False))
    resolved = answered & F.coalesce(F.col("status").isin(CONFIRMED, REJECTED), F.lit(False))
    number = lambda *flags: sum((f.cast("int") for f in flags), F.lit(0))
    return log.select("request_id", taken.alias("taken"), answered.alias("answered"), resolved.alias("resolved"),
                      number(F.lit(True), taken, answered).alias("checks"), number(taken, answered, resolved).alias("passed"))


def check_report(log: DataFrame, least_rate: float = THRESHOLDS["sustained"][2]) -> DataFrame:
    """Checks run and passed over all requests, the rate of each check among those that ran it, and whether enough passed."""
    rate = lambda part, whole: F.when(whole > 0, part / whole)
    row = request_checks(log).agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"),
        F.count_if("taken").alias("taken"), F.count_if("answered").alias("completed"), F.count_if("resolved").alias("resolved"))
    return row.select(
        "requests", "checks", "passed", "completed", rate(F.col("passed"), F.col("checks")).alias("pass_rate"),
        rate(F.col("taken"), F.col("requests")).alias("post_rate"), rate(F.col("completed"), F.col("taken")).alias("get_rate"),
        rate(F.col("resolved"), F.col("completed")).alias("resolved_rate")).withColumn("checks_ok", F.col("pass_rate") > least_rate)
