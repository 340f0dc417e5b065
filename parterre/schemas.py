"""Record layouts of the reservation log and of the relational tables."""

from pyspark.sql import types as T

SECTION = ["event_id", "section"]

COMMAND = T.StructType([
    T.StructField("reservation_id", T.StringType(), False),
    T.StructField("event_id", T.LongType(), False),
    T.StructField("section", T.StringType(), False),
    T.StructField("seat_count", T.IntegerType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

SECTION_INIT = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("section", T.StringType(), False),
    T.StructField("rows", T.IntegerType(), False),
    T.StructField("seats_per_row", T.IntegerType(), False),
    T.StructField("initial_reserved", T.ArrayType(T.StringType()), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

SECTION_STATE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("section", T.StringType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("available_count", T.IntegerType()),
    T.StructField("run_starts", T.ArrayType(T.IntegerType())),
    T.StructField("run_stops", T.ArrayType(T.IntegerType())),
    T.StructField("ts", T.TimestampNTZType()),
])

# What sits on the wire: times are plain epoch milliseconds, not a timestamp
# type, so readers of foreign logs convert with functions.time.from_millis.
COMMAND_WIRE = T.StructType(
    [f for f in COMMAND if f.name != "ts"] + [T.StructField("timestamp", T.LongType(), False)]
)

COMPLETED = T.StructType([
    T.StructField("reservation_id", T.StringType(), False),
    T.StructField("event_id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("section", T.StringType(), True),
    T.StructField("seat_count", T.IntegerType(), True),
    T.StructField("allocated_seats", T.ArrayType(T.StringType()), True),
    T.StructField("completed_ts", T.TimestampNTZType(), False),
])

SECTION_STATUS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("section", T.StringType(), False),
    T.StructField("available_count", T.IntegerType(), False),
    T.StructField("status_ts", T.TimestampNTZType(), False),
])

VENUE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("address", T.StringType(), False),
    T.StructField("capacity", T.IntegerType(), False),
])

EVENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("event_date", T.DateType(), False),
    T.StructField("venue_id", T.LongType(), False),
])

TICKET = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_id", T.LongType(), False),
    T.StructField("seat_number", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("price", T.DecimalType(12, 2), False),
])

RESERVATION = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ticket_id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

# The status words the data model admits.
TICKET_STATUSES = ["AVAILABLE", "RESERVED", "SOLD"]
RESERVATION_STATUSES = ["PENDING", "CONFIRMED", "CANCELLED"]
CONFIRMED = "CONFIRMED"
REJECTED = "REJECTED"
AVAILABLE = "AVAILABLE"
RESERVED = "RESERVED"
