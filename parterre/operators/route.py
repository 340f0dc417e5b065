"""Pre-filter, split and fan-in around the allocator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.operators.allocate import replay, results_of, states_of
from parterre.operators.asof import as_of_join
from parterre.operators.fold import INIT
from parterre.operators.skew import estimated_bytes
from parterre.operators.tables import exists_flag, latest_by_key
from parterre.schemas import REJECTED, SECTION, SECTION_INIT, SECTION_STATE
from parterre.session import materialize


def latest_section_status(changelog: DataFrame) -> DataFrame:
    """The availability table: the last status of each section.

    Of several at one time the last is that of the highest epoch with the fewest
    seats left, since availability only falls within an epoch.
    """
    return latest_by_key(changelog, SECTION, ["status_ts", "epoch", -F.col("available_count")])


def with_verdict(commands: DataFrame, status: DataFrame) -> DataFrame:
    """Commands with ``enough``: is the known availability sufficient?

    ``status`` has one row per section. A section without status passes, so
    ``enough`` is never null and the two branches below lose no command. No
    broadcast is forced: Catalyst sends the table along when its size allows,
    and otherwise adaptive execution splits a hot section's commands.
    """
    known = status.select(*SECTION, F.col("available_count").alias("known_available"))
    joined = commands.join(known, SECTION, "left")
    enough = F.col("known_available").isNull() | (F.col("known_available") >= F.col("seat_count"))
    return joined.withColumn("enough", F.coalesce(enough, F.lit(False))).select(
        *commands.columns, "known_available", "enough")


def with_status_as_of(commands: DataFrame, changelog: DataFrame) -> DataFrame:
    """Commands with the availability of their section as it stood just before them, and since when (``known_ts``).

    ``changelog`` has (section, epoch, available_count, status_ts) and may hold the commands' own effects, which come after them.
    """
    known = changelog.select(*SECTION, "epoch", F.col("available_count").alias("known_available"), F.col("status_ts").alias("known_ts"))
    return as_of_join(commands, known, SECTION, "ts", "known_ts", ["known_available", "known_ts"], before=True,
                      ties=["epoch", -F.col("known_available")])


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("enough")).drop("enough", "known_available")


def rejected(judged: DataFrame) -> DataFrame:
    """Commands turned away before the allocator, in the layout of its results."""
    return judged.where(~F.col("enough")).select(
        "reservation_id", *SECTION, "seat_count", "user_id", F.lit(None).cast("bigint").alias("epoch"),
        F.lit(REJECTED).alias("status"), F.lit(None).cast("int").alias("first_seat"),
        F.col("ts").alias("completed_ts"))


def prefilter(commands: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted commands, rejected results)."""
    judged = with_verdict(commands, status)
    return accepted(judged), rejected(judged)


# Before any set-up or command; a carried state enters the replay at this time.
BEFORE_ALL = "timestamp_ntz'0001-01-01 00:00:00'"


def route_batch(commands: DataFrame, inits: DataFrame, states: DataFrame, *, shed: bool = True) -> DataFrame:
    """The replayed rows of one batch, starting from ``states``, with ``prefiltered`` where they were turned away at the door.

    The states also tell the availability that the batch is judged by, and they meet the commands only once: the fold, which
    has both of a section in one place, compares each request with what its section had at the start. A section set up anew
    in this batch may have more seats than that, so its commands are all judged by the allocator. Rows turned away have
    neither epoch nor availability, as no allocator has seen them.
    """
    carried = states.withColumn("ts", F.expr(BEFORE_ALL))
    if shed:
        anew = exists_flag(carried, inits, {c: c for c in SECTION}, "set_up_anew")
        carried = anew.withColumn("door", F.when(~F.col("set_up_anew"), F.col("available_count"))).drop("set_up_anew")
    outcome = replay(commands, inits, carried, with_states=True, with_status=True, size=estimated_bytes(commands))
    if not shed:
        outcome = outcome.withColumn("prefiltered", F.lit(False))
    seen = ~F.coalesce("prefiltered", F.lit(False))
    # A carried state enters as a set-up row; it is not a new status.
    return outcome.where((F.col("kind") != INIT) | (F.col("ts") != F.expr(BEFORE_ALL))).withColumns(
        {c: F.when(seen, F.col(c)) for c in ("epoch", "available_count")})


class Route:
    """Commands and set-ups from arrival to completion, batch after batch.

    Each batch sees the states left by the batch before it, and the set-ups that
    arrive with it. The outcome of a batch is written once and read by its
    consumers: completed results, the changelog, and the next batch.
    """

    def __init__(self) -> None:
        self.states: DataFrame | None = None

    def run(self, commands: DataFrame, inits: DataFrame | None = None) -> DataFrame:
        """Completed results of one batch, with ``prefiltered`` telling where they ended."""
        spark = commands.sparkSession
        inits = spark.createDataFrame([], SECTION_INIT) if inits is None else inits
        known = spark.createDataFrame([], SECTION_STATE) if self.states is None else self.states
        outcome = materialize(route_batch(commands, inits, known, shed=self.states is not None), "route-batch")
        self.states = states_of(outcome, F.expr(BEFORE_ALL))
        return results_of(outcome, "prefiltered")


__all__ = ["Route", "accepted", "latest_section_status", "prefilter", "rejected", "route_batch", "with_status_as_of", "with_verdict"]
