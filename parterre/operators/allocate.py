"""Seat allocation: the ordered replay of commands against section inventories.

Ordinary sections take one shuffle: rows are hash-partitioned by section, sorted
by time, and folded as they stream by.

A section with more rows than one task should see takes another way to the same
result. Within one set-up (an epoch) seats are only ever taken, so a request
size that fails once fails for good. Of the requests for ``n`` seats only the
first ``free // n`` can succeed; all later ones are rejections, exactly. Their
ranks come from slice-wise running counts, so only as many requests as the
section has seats for reach the fold, whatever the section's traffic.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.functions.seats import seat_names
from parterre.operators import fold as fold_module
from parterre.operators.fold import COMMAND, CONSUMED, INIT, STATE, section_fold
from parterre.operators.inventory import INT_ARRAY, free_count, run_lengths, with_free_runs
from parterre.operators.running import drop_slices, first_in_slices, heavy_rows, running_over_slices, slice_ordered
from parterre.operators.skew import estimated_bytes, heavy_keys, split_heavy
from parterre.operators.tables import latest_by_key
from parterre.schemas import CONFIRMED, REJECTED, SECTION
from parterre.session import FOLD_TASK_BYTES, MOST_FOLD_TASKS, int_setting, materialize

# The fold travels with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(fold_module)

# Commands in time order, set-ups before commands of the same time; the further
# columns make the order total, so that a replay always gives one result.
ORDER = ["ts", "kind", "reservation_id", "seat_count", "user_id", "step", "run_starts", "run_stops"]
_LANE = [*SECTION, "lane"]


def command_rows(commands: DataFrame) -> DataFrame:
    # Empty rather than null runs: null lists are slow to hand to Python.
    return commands.selectExpr(
        *SECTION, "ts", "reservation_id", "seat_count", "user_id", f"{COMMAND} as kind", "cast(null as bigint) as step",
        f"cast(array() as {INT_ARRAY}) as run_starts", f"cast(array() as {INT_ARRAY}) as run_stops")


def init_rows(inits: DataFrame) -> DataFrame:
    """Set-up rows; each starts a new epoch of its section."""
    return _inventory_rows(with_free_runs(inits), "1L")


def state_rows(states: DataFrame) -> DataFrame:
    """Carried states as set-up rows that continue their epoch."""
    return _inventory_rows(states, "epoch", *(["door"] if "door" in states.columns else []))


def _inventory_rows(rows: DataFrame, step: str, *more: str) -> DataFrame:
    return rows.selectExpr(
        *SECTION, "ts", "cast(null as string) as reservation_id", "cast(null as int) as seat_count",
        "cast(null as string) as user_id", f"{INIT} as kind", f"{step} as step", "run_starts", "run_stops", *more)


def replay(
    commands: DataFrame, inits: DataFrame, states: DataFrame | None = None,
    *, with_states: bool = False, with_status: bool = False, size: int | None = None,
) -> DataFrame:
    """Every set-up and command with its outcome, tagged by ``kind``.

    ``states`` are section states of an earlier replay to continue from.
    ``with_states`` adds the final free runs of each section as STATE rows;
    ``with_status`` fills ``available_count`` on every row of a known section;
    otherwise only STATE rows have it. ``size`` is the estimated size of the
    commands if known from before a join. Where ``states`` have a ``door``, the
    outcome has ``prefiltered``: whether more seats were asked for than that.
    """
    timeline = command_rows(commands).unionByName(init_rows(inits))
    if states is not None:
        timeline = timeline.unionByName(state_rows(states), allowMissingColumns=True)
    size = estimated_bytes(timeline) if size is None else size
    heavy = heavy_keys(timeline, SECTION, size)
    if heavy is None:
        outcome = _fold(timeline, SECTION, with_states, size)
    else:
        ordinary, large = split_heavy(timeline, SECTION, heavy)
        spread = _replay_heavy(large, heavy_rows(heavy), with_states, with_status)
        outcome = _fold(ordinary, SECTION, with_states, size).unionByName(spread)
    if with_status:
        return outcome
    return outcome.withColumn("available_count", F.when(F.col("kind") == STATE, F.col("available_count")))


def _fold(timeline: DataFrame, keys: list[str], with_states: bool, size: int | None = None) -> DataFrame:
    arranged = _by_key(timeline, keys, size).sortWithinPartitions(*keys, *ORDER)
    added = [T.StructField("epoch", T.LongType()), T.StructField("first_seat", T.IntegerType()),
             T.StructField("available_count", T.IntegerType())]
    if "door" in timeline.columns:
        added.append(T.StructField("prefiltered", T.BooleanType()))
    kept = [T.StructField(f.name, f.dataType) for f in timeline.schema if f.name not in CONSUMED]
    return arranged.mapInArrow(section_fold(keys, with_states), T.StructType(kept + added))


def _by_key(timeline: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """Every key whole in one partition.

    The rows are partitioned by a hash of the keys, not the keys themselves: were
    the input already partitioned by them, as after a join, Spark would drop this
    shuffle as redundant, and adaptive execution, unaware that the fold needs
    whole sections, might then split a skewed partition of that join.

    An input too large for the session's default number of partitions gets more,
    up to ``parterre.mostFoldTasks``; one of unknown size gets the default. A number that is asked for stays as it is;
    the default may be merged by adaptive execution.
    """
    wanted = fold_partitions(timeline, size)
    whole = F.xxhash64(*keys)
    return timeline.repartition(whole) if wanted is None else timeline.repartition(wanted, whole)


def fold_partitions(timeline: DataFrame, size: int | None = None) -> int | None:
    """How many partitions a fold asks for; None for the session's default."""
    spark = timeline.sparkSession
    size = estimated_bytes(timeline) if size is None else size
    wanted = min(-(-(size or 0) // int_setting(spark, FOLD_TASK_BYTES)), int_setting(spark, MOST_FOLD_TASKS))
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _replay_heavy(timeline: DataFrame, rows: int, with_states: bool, with_status: bool) -> DataFrame:
    sliced = slice_ordered(timeline, SECTION, ORDER, rows)
    opening = F.col("kind") == INIT
    guarded = "door" in timeline.columns
    epochs = running_over_slices(
        sliced, SECTION, ORDER,
        sums={"lane": F.when(opening, F.col("step")).otherwise(F.lit(0))},
        lasts={"free": F.when(opening, free_count()),
               "longest": F.when(opening, F.coalesce(F.array_max(run_lengths()), F.lit(0))),
               **({"door": F.when(opening, F.col("door"))} if guarded else {})},
        sparse=True)

    size = F.coalesce("seat_count", F.lit(0))
    can_fit = size.between(1, F.col("longest"))
    bound = F.when(can_fit, F.floor(F.col("free") / size)).otherwise(F.lit(0))
    requests = epochs.where(F.col("kind") == COMMAND).withColumn("size", size)
    first, rest = first_in_slices(requests, [*_LANE, "size"], ORDER, bound)
    helpers = ["free", "longest", "size"]

    contenders = first.drop(*helpers).unionByName(epochs.where(opening).drop("free", "longest"))
    # Each lane opens with its own set-up row, which makes its step the lane number.
    folded = _fold(contenders.withColumn("step", F.col("lane")), _LANE, with_states)
    early = [F.coalesce(F.col("seat_count") > F.col("door"), F.lit(False)).alias("prefiltered")] if guarded else []
    refused = rest.drop(*helpers).select(
        "*", F.col("lane").alias("epoch"), F.lit(None).cast("int").alias("first_seat"),
        F.lit(None).cast("int").alias("available_count"), *early).drop(*CONSUMED)
    outcome = folded.unionByName(refused)
    if with_status:
        outcome = materialize(outcome.withColumn("step", F.lit(None).cast("bigint")), "outcomes")
        filled = running_over_slices(
            outcome.where(F.col("kind") != STATE), SECTION, ORDER,
            lasts={"available_count": F.col("available_count")}, sparse=True)
        outcome = outcome.where(F.col("kind") == STATE).unionByName(filled).drop("step")
    outcome = drop_slices(outcome).drop("lane")
    if with_states:
        final = latest_by_key(outcome.where(F.col("kind") == STATE), SECTION, ["epoch"])
        outcome = outcome.where(F.col("kind") != STATE).unionByName(final)
    return outcome


def results_of(replayed: DataFrame, *extra: str) -> DataFrame:
    """The outcome of each command, with any ``extra`` columns."""
    return replayed.where(f"kind = {COMMAND}").selectExpr(
        "reservation_id", *SECTION, "seat_count", "user_id", "epoch",
        f"if(first_seat is not null, '{CONFIRMED}', '{REJECTED}') as status", "first_seat", "ts as completed_ts", *extra)


def states_of(replayed: DataFrame, as_of: Column) -> DataFrame:
    """Section states to continue from, stamped with a time before the rows to come."""
    return replayed.where(F.col("kind") == STATE).select(
        *SECTION, "epoch", "available_count", "run_starts", "run_stops", as_of.alias("ts"))


def status_of(replayed: DataFrame) -> DataFrame:
    """The availability changelog: one row per set-up and per command of a known section."""
    known = F.col("kind").isin(INIT, COMMAND) & F.col("available_count").isNotNull()
    return replayed.where(known).select(
        *SECTION, "epoch", "kind", "reservation_id", "available_count", F.col("ts").alias("status_ts"))


def allocate_seats(commands: DataFrame, inits: DataFrame) -> DataFrame:
    """CONFIRMED or REJECTED for every command, with the first seat and epoch."""
    return results_of(replay(commands, inits))


def anonymous(commands: DataFrame) -> DataFrame:
    """Commands without their users, for consumers that do not ask who booked.

    The user only breaks ties between equal requests of one time and id, which
    leaves seats and statuses as they are; the column is then never read.
    """
    return commands.withColumn("user_id", F.lit(None).cast("string"))


def status_changelog(commands: DataFrame, inits: DataFrame) -> DataFrame:
    return status_of(replay(anonymous(commands), inits, with_status=True))


def final_states(commands: DataFrame, inits: DataFrame) -> DataFrame:
    """Free runs and count of each section after the last command."""
    replayed = replay(anonymous(commands), inits, with_states=True)
    return states_of(replayed, F.lit(None).cast("timestamp_ntz"))


def with_seat_names(results: DataFrame) -> DataFrame:
    """Add ``allocated_seats``; empty for rejected commands."""
    names = seat_names(F.col("section"), F.col("first_seat"), F.col("seat_count"))
    return results.withColumn("allocated_seats", names)


def seats_taken(results: DataFrame) -> DataFrame:
    """One row per seat of a confirmed result."""
    last = F.col("first_seat") + F.col("seat_count") - 1
    return results.where(F.col("first_seat").isNotNull()).select(
        *SECTION, "epoch", "reservation_id", F.explode(F.sequence("first_seat", last)).alias("seat_no"))

