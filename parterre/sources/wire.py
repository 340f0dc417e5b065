"""Records of the reservation log as they travel: published field names, times as epoch milliseconds.

Five layouts: commands, completions, section set-ups, section states and status
events. ``to_`` functions give the records of tables, ``from_`` functions the
tables of records; :func:`encoded` and :func:`decoded` put them into JSON text and
back. Times keep their milliseconds, what is finer is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.functions.seats import seat_names, seat_number
from parterre.functions.time import from_millis, to_millis
from parterre.operators.inventory import INT_ARRAY
from parterre.schemas import AVAILABLE, RESERVED

# The published records, their fields in order.
_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
RECORDS = {
    "ReservationCommand": {"reservationId": _STRING, "eventId": _LONG, "section": _STRING, "seatCount": _INT, "userId": _STRING, "timestamp": _LONG},
    "ReservationCompletedEvent": {"reservationId": _STRING, "eventId": _LONG, "userId": _STRING, "status": _STRING, "section": _STRING,
                                  "seatCount": _INT, "allocatedSeats": T.ArrayType(_STRING), "timestamp": _LONG},
    "SectionInitCommand": {"eventId": _LONG, "section": _STRING, "rows": _INT, "seatsPerRow": _INT, "initialReserved": T.ArrayType(_STRING)},
    "SectionSeatState": {"eventId": _LONG, "section": _STRING, "seatStatuses": T.MapType(_STRING, _STRING), "availableCount": _INT},
    "SectionStatusEvent": {"eventId": _LONG, "section": _STRING, "availableCount": _INT, "timestamp": _LONG},
}
# What a missing field of a record counts as.
DEFAULTS = {"ReservationCompletedEvent": {"section": "", "seatCount": 0}, "SectionInitCommand": {"initialReserved": []}}
_NAMES = {"reservationId": "reservation_id", "eventId": "event_id", "seatCount": "seat_count", "userId": "user_id", "seatsPerRow": "seats_per_row",
          "initialReserved": "initial_reserved", "allocatedSeats": "allocated_seats", "availableCount": "available_count"}


def layout(record: str) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in RECORDS[record].items()])


def _to(df: DataFrame, record: str, time: str | None, **given: Column) -> DataFrame:
    def value(name: str) -> Column:
        if name in given:
            return given[name]
        return to_millis(F.col(time)) if name == "timestamp" else F.col(_NAMES.get(name, name))

    return df.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in layout(record)])


def _from(records: DataFrame, record: str, time: str | None) -> DataFrame:
    def value(field: T.StructField) -> Column:
        column = F.col(field.name)
        if field.name in DEFAULTS.get(record, {}):
            default = DEFAULTS[record][field.name]
            column = F.coalesce(column, F.array().cast(field.dataType) if default == [] else F.lit(default))
        return from_millis(column).alias(time) if field.name == "timestamp" else column.alias(_NAMES.get(field.name, field.name))

    return records.select(*map(value, layout(record)))


def to_commands(commands: DataFrame) -> DataFrame:
    return _to(commands, "ReservationCommand", "ts")


def from_commands(records: DataFrame) -> DataFrame:
    return _from(records, "ReservationCommand", "ts")


def to_completions(results: DataFrame) -> DataFrame:
    """Of results with ``first_seat``; seats are named, none for rejections."""
    seats = seat_names(F.col("section"), F.col("first_seat"), F.col("seat_count"))
    return _to(results, "ReservationCompletedEvent", "completed_ts", allocatedSeats=F.coalesce(seats, F.array().cast("array<string>")))


def from_completions(records: DataFrame) -> DataFrame:
    return _from(records, "ReservationCompletedEvent", "completed_ts")


def to_inits(inits: DataFrame) -> DataFrame:
    return _to(inits, "SectionInitCommand", None)


def from_inits(records: DataFrame) -> DataFrame:
    """Set-ups without a time; whoever reads them gives one."""
    return _from(records, "SectionInitCommand", None)


def to_statuses(changelog: DataFrame) -> DataFrame:
    return _to(changelog, "SectionStatusEvent", "status_ts")


def from_statuses(records: DataFrame) -> DataFrame:
    return _from(records, "SectionStatusEvent", "status_ts")


def to_states(states: DataFrame, seats: Column) -> DataFrame:
    """Section states with the status of each of ``seats`` seats by name; what lies in no free run is reserved."""
    numbers = F.when(seats > 0, F.sequence(F.lit(1), seats)).otherwise(F.array().cast(INT_ARRAY))
    free = lambda n: F.exists(F.arrays_zip("run_starts", "run_stops"), lambda r: (r["run_starts"] <= n) & (n < r["run_stops"]))
    statuses = F.map_from_entries(F.transform(numbers, lambda n: F.struct(
        F.concat_ws("-", "section", n.cast("string")), F.when(free(n), F.lit(AVAILABLE)).otherwise(F.lit(RESERVED)))))
    return _to(states, "SectionSeatState", None, seatStatuses=statuses)


def from_states(records: DataFrame) -> DataFrame:
    """Section states with their free runs."""
    pairs = F.filter(F.map_entries("seatStatuses"), lambda e: e["value"] == AVAILABLE)
    rows = records.select("*", F.array_sort(F.transform(pairs, lambda e: seat_number(e["key"]))).alias("free"))
    begins = F.filter("free", lambda n, i: (i == 0) | (F.get("free", i - 1) != n - 1))
    ends = F.transform(F.filter("free", lambda n, i: F.coalesce(F.get("free", i + 1) != n + 1, F.lit(True))), lambda n: n + 1)
    return rows.select(F.col("eventId").alias("event_id"), "section", F.col("availableCount").alias("available_count"),
                       begins.cast(INT_ARRAY).alias("run_starts"), ends.cast(INT_ARRAY).alias("run_stops"))


def encoded(records: DataFrame, key: Column) -> DataFrame:
    """Text keys and JSON values of records."""
    return records.select(key.cast("string").alias("key"), F.to_json(F.struct(*records.columns)).alias("value"))


def decoded(values: DataFrame, record: str) -> DataFrame:
    """Records of JSON values; fields that are missing are null."""
    return values.select(F.from_json("value", layout(record)).alias("r")).select("r.*")
