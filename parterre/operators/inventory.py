"""Section set-up and seat inventories.

A section is declared by its rows and seats per row; seats are numbered across
rows from 1. Inside the engine the free seats of a section are a short list of
maximal free runs ``[start, stop)`` instead of a map of every seat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parterre.functions.seats import seat_name, seat_number
from parterre.operators.tables import latest_by_key
from parterre.schemas import AVAILABLE, RESERVED, SECTION

INT_ARRAY = "array<int>"


def total_seats(rows: Column, seats_per_row: Column) -> Column:
    return F.when((rows > 0) & (seats_per_row > 0), rows * seats_per_row).otherwise(F.lit(0)).cast("int")


_SEAT_NO = "try_cast(substr(name, length(section) + 2) as int)"


def with_free_runs(inits: DataFrame) -> DataFrame:
    """Add the free runs of each declared section as ``run_starts`` and ``run_stops``.

    A name in ``initial_reserved`` counts only when it is exactly the name of a
    seat of the section; all others are ignored. The free runs are the gaps
    between the fences 0, the taken numbers, and one past the last seat.
    """
    is_seat = f"name = concat(section, '-', {_SEAT_NO}) and {_SEAT_NO} between 1 and total"
    return (
        inits.selectExpr("*", "cast(if(rows > 0 and seats_per_row > 0, rows * seats_per_row, 0) as int) as total")
        .selectExpr("*", f"""coalesce(sort_array(array_distinct(
            transform(filter(initial_reserved, name -> {is_seat}), name -> {_SEAT_NO}))), array()) as taken""")
        .selectExpr("*", "filter(zip_with(concat(array(0), taken), concat(taken, array(total + 1)), "
                         "(low, high) -> struct(low + 1 as start, high as stop)), gap -> gap.stop > gap.start) as free")
        .selectExpr(*inits.columns, "free.start as run_starts", "free.stop as run_stops")
    )


def run_lengths() -> Column:
    return F.zip_with("run_starts", "run_stops", lambda start, stop: stop - start)


def free_count() -> Column:
    return F.aggregate(run_lengths(), F.lit(0), lambda total, n: total + n)


def latest_inits(inits: DataFrame) -> DataFrame:
    """A later set-up of a section replaces the earlier one."""
    return latest_by_key(inits, SECTION, ["ts", "rows", "seats_per_row", "initial_reserved"])


def _numbered(sections: DataFrame) -> DataFrame:
    """One row per seat of each section, with ``seat_no`` and ``seat``."""
    filled = sections.where((F.col("rows") > 0) & (F.col("seats_per_row") > 0))
    # Rows first, then the seats of each row: no array as long as the section.
    by_row = filled.withColumn("seat_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    by_seat = by_row.withColumn("seat_col", F.explode(F.sequence(F.lit(1), F.col("seats_per_row"))))
    number = ((F.col("seat_row") - 1) * F.col("seats_per_row") + F.col("seat_col")).cast("int")
    return by_seat.withColumn("seat_no", number).withColumn("seat", seat_name(F.col("section"), F.col("seat_no")))


def _free(number: Column) -> Column:
    """Does a free run hold the seat?"""
    runs = F.arrays_zip("run_starts", "run_stops")
    held = F.exists(runs, lambda run: (run["run_starts"] <= number) & (number < run["run_stops"]))
    return F.when(held, F.lit(AVAILABLE)).otherwise(F.lit(RESERVED))


def seat_inventory(inits: DataFrame) -> DataFrame:
    """One row per seat of the current set-up, AVAILABLE or RESERVED."""
    taken = F.coalesce(F.array_contains("initial_reserved", F.col("seat")), F.lit(False))
    return _numbered(latest_inits(inits)).select(
        *SECTION, "seat_no", "seat", F.when(taken, RESERVED).otherwise(AVAILABLE).alias("status"))


def _with_states(inits: DataFrame, states: DataFrame) -> DataFrame:
    runs = states.select(*SECTION, "run_starts", "run_stops", "available_count")
    return latest_inits(inits).join(runs, SECTION, "inner")


def seat_inventory_of_states(inits: DataFrame, states: DataFrame) -> DataFrame:
    """The inventory after allocation, from final states.

    Only sections are shuffled; their seats are laid out after the join.
    """
    return _numbered(_with_states(inits, states)).select(
        *SECTION, "seat_no", "seat", _free(F.col("seat_no")).alias("status"))


def seat_maps_of_states(inits: DataFrame, states: DataFrame) -> DataFrame:
    """The record view after allocation: one map of seat name to status per section."""
    total = total_seats(F.col("rows"), F.col("seats_per_row"))
    numbers = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast(INT_ARRAY))
    entry = lambda n: F.struct(seat_name(F.col("section"), n).alias("seat"), _free(n).alias("status"))
    return _with_states(inits, states).select(
        *SECTION, F.map_from_entries(F.transform(numbers, entry)).alias("seat_statuses"), "available_count")


def section_init_status(inits: DataFrame) -> DataFrame:
    """Available seats of every set-up section; empty sections count 0.

    Counted per declared section from its free runs, so no seat rows are made.
    """
    counted = with_free_runs(latest_inits(inits))
    return counted.select(*SECTION, free_count().alias("available_count"), F.col("ts").alias("status_ts"))


def seat_inventory_final(inits: DataFrame, seats_taken: DataFrame) -> DataFrame:
    """The inventory after allocation, from results: ``seats_taken`` has one row per allocated seat.

    Joined per seat, so the seats of one large section spread over many tasks.
    """
    sold = seats_taken.select(*SECTION, "seat_no").distinct().withColumn("sold", F.lit(True))
    status = F.when(F.col("sold"), F.lit(RESERVED)).otherwise(F.col("status"))
    return seat_inventory(inits).join(sold, [*SECTION, "seat_no"], "left").withColumn("status", status).drop("sold")


def seat_maps(seats: DataFrame) -> DataFrame:
    """The record view of an inventory: one map of seat name to status per section.

    A group here is one section's seats, the size of the record itself.
    """
    entries = F.collect_list(F.struct("seat", "status"))
    return seats.groupBy(*SECTION).agg(
        F.map_from_entries(entries).alias("seat_statuses"),
        F.count_if(F.col("status") == AVAILABLE).cast("int").alias("available_count"),
    )


def available_seat_list(seat_statuses: Column) -> Column:
    """Names of the available seats of a map, ordered by their numbers."""
    free = F.map_keys(F.map_filter(seat_statuses, lambda _, status: status == AVAILABLE))
    numbered = F.transform(free, lambda seat: F.struct(seat_number(seat).alias("n"), seat.alias("seat")))
    return F.transform(F.array_sort(numbered), lambda pair: pair["seat"])


def free_runs(seats: DataFrame) -> DataFrame:
    """Maximal runs of consecutive available seats, from seat rows.

    Numbers minus their rank are constant within a run. The window holds the
    free seats of one section.
    """
    rank = F.row_number().over(Window.partitionBy(*SECTION).orderBy("seat_no"))
    island = seats.where(F.col("status") == AVAILABLE).withColumn("island", F.col("seat_no") - rank)
    return island.groupBy(*SECTION, "island").agg(
        F.min("seat_no").alias("run_start"), F.count(F.lit(1)).cast("int").alias("run_length")
    ).drop("island")


def free_runs_of_state(states: DataFrame) -> DataFrame:
    """The same runs, read from section states without making seat rows."""
    zipped = F.arrays_zip("run_starts", "run_stops")
    return states.select(*SECTION, F.explode(zipped).alias("run")).where("run.run_stops > run.run_starts").select(
        *SECTION, F.col("run.run_starts").alias("run_start"),
        (F.col("run.run_stops") - F.col("run.run_starts")).alias("run_length"))


def first_fit_start(states: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each section and wanted size: where the lowest run that fits begins.

    ``sizes`` has distinct (event_id, section, seat_count); sizes that fit
    nowhere give no row.
    """
    runs = F.arrays_zip("run_starts", "run_stops")
    fitting = F.filter(runs, lambda r: r["run_stops"] - r["run_starts"] >= F.col("seat_count"))
    first = F.array_min(F.transform(fitting, lambda r: r["run_starts"]))
    return (
        sizes.join(states.select(*SECTION, "run_starts", "run_stops"), SECTION, "inner")
        .select(*SECTION, "seat_count", first.alias("first_seat"))
        .where("first_seat is not null")
    )
