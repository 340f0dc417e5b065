"""Invariants over results, as queries that return the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.functions.seats import seat_number
from parterre.operators.allocate import seats_taken
from parterre.operators.inventory import free_count, latest_inits, total_seats, with_free_runs
from parterre.schemas import CONFIRMED, REJECTED, SECTION


def duplicate_seats(results: DataFrame) -> DataFrame:
    """Seats confirmed more than once within one epoch of a section.

    A count per seat, combined before the shuffle; no group is gathered.
    """
    return seats_taken(results).groupBy(*SECTION, "epoch", "seat_no").agg(
        F.count(F.lit(1)).alias("times")).where("times > 1")


def allocation_violations(results: DataFrame) -> DataFrame:
    """Results whose seats are not what was asked for.

    Confirmed: exactly ``seat_count`` seats, all of the section, consecutively
    numbered. Rejected: none. Works on rendered ``allocated_seats``.
    """
    seats = F.coalesce("allocated_seats", F.array().cast("array<string>"))
    numbers = F.transform(seats, seat_number)
    expected = F.transform(F.sequence(F.lit(1), F.size(seats)), lambda i: F.element_at(numbers, 1) + i - 1)
    in_section = F.forall(seats, lambda s: s == F.concat_ws("-", "section", seat_number(s).cast("string")))
    consecutive = F.when(F.size(seats) > 0, numbers == expected).otherwise(F.lit(True))
    problem = (
        F.when(~F.col("status").isin(CONFIRMED, REJECTED), "unknown status")
        .when((F.col("status") == REJECTED) & (F.size(seats) > 0), "seats on a rejection")
        .when((F.col("status") == CONFIRMED) & (F.size(seats) != F.col("seat_count")), "wrong number of seats")
        .when(~in_section, "seat of another section")
        .when(~consecutive, "seats not consecutive")
    )
    return results.withColumn("problem", problem).where(F.col("problem").isNotNull())


def inventory_balance(inits: DataFrame, results: DataFrame, states: DataFrame) -> DataFrame:
    """Per section: total, available and reserved seats, and the count the allocator kept.

    Counts the distinct seats that the results of a section's current set-up take;
    earlier set-ups are over. ``balanced`` holds when those leave the kept count.
    No seats are laid out: three tables with a row per section are joined.
    """
    kept = states.select(*SECTION, "epoch", F.col("available_count").cast("bigint").alias("kept_available"))
    sold = seats_taken(results).groupBy(*SECTION, "epoch").agg(F.countDistinct("seat_no").alias("sold"))
    declared = with_free_runs(latest_inits(inits)).select(
        *SECTION, total_seats(F.col("rows"), F.col("seats_per_row")).cast("bigint").alias("total"),
        free_count().cast("bigint").alias("free"))
    joined = declared.join(kept, SECTION, "left").join(sold, [*SECTION, "epoch"], "left").na.fill(0, ["sold"])
    available = F.col("free") - F.col("sold")
    return joined.select(
        *SECTION, "total", available.alias("available"), (F.col("total") - available).alias("reserved"), "kept_available",
        ((available >= 0) & available.eqNullSafe(F.col("kept_available"))).alias("balanced"))


def unresolved_commands(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Reservation ids that do not have exactly one final result per command.

    Counts both sides by id in one aggregate instead of joining them.
    """
    final = F.col("status").isin(CONFIRMED, REJECTED).cast("bigint")
    sides = commands.select("reservation_id", F.lit(1).cast("bigint").alias("asked"), F.lit(0).cast("bigint").alias("answered"))
    answers = results.select("reservation_id", F.lit(0).cast("bigint").alias("asked"), final.alias("answered"))
    return sides.unionByName(answers).groupBy("reservation_id").agg(
        F.sum("asked").alias("asked"), F.sum("answered").alias("answered")).where("asked <> answered")
