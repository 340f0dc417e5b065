"""The load client's vocabulary: areas, states and seat grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.functions.seats import grid_position
from parterre.operators.asof import as_of_join
from parterre.operators.tables import latest_by_key
from parterre.schemas import CONFIRMED, RESERVED


def sections_of_areas(areas: Column) -> Column:
    """Nested areas under the names the engine uses."""
    return F.transform(areas, lambda a: F.struct(
        a["area_id"].alias("section"), a["row_count"].alias("rows"), a["col_count"].alias("seats_per_row")))


def capacity_of_areas(areas: Column) -> Column:
    return F.aggregate(areas, F.lit(0).cast("bigint"),
                       lambda total, a: total + a["row_count"].cast("bigint") * a["col_count"])


def reservation_request(requests: DataFrame) -> DataFrame:
    """A reservation request under the engine's names."""
    return requests.withColumnsRenamed({"area_id": "section", "num_of_seats": "seat_count"})


def compat_results(results: DataFrame) -> DataFrame:
    """Completed results as the load client reads them.

    ``results`` carries ``allocated_seats``; missing seats become an empty list.
    """
    state = F.when(F.col("status") == CONFIRMED, F.lit(RESERVED)).otherwise(F.col("status"))
    seats = F.transform("allocated_seats", grid_position)
    nothing = F.array().cast("array<struct<row:int,col:int>>")
    return results.select(
        "reservation_id", "user_id", F.col("event_id").cast("string").alias("event_id"),
        F.col("section").alias("area_id"), F.col("seat_count").alias("num_of_seats"), state.alias("state"),
        F.coalesce(seats, nothing).alias("seats"))


def resolve_event_names(requests: DataFrame, registrations: DataFrame, order: list[str]) -> DataFrame:
    """Requests with the id last registered under their event name; null where there is none.

    ``registrations`` has (event_name, event_id) and the ``order`` columns.
    """
    current = latest_by_key(registrations, ["event_name"], order).select("event_name", "event_id")
    return requests.join(current, "event_name", "left")


def resolve_event_names_as_of(requests: DataFrame, registrations: DataFrame, request_time: str = "ts") -> DataFrame:
    """Requests with the id that was last registered under their event name when they were made; null where none was.

    ``registrations`` has (event_name, event_id, registered_ts); of several at one time the highest id counts.
    """
    return as_of_join(requests, registrations, ["event_name"], request_time, "registered_ts", ["event_id"], ties=["event_id"])
