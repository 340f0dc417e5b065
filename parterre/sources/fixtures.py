"""Reservation-log views over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.schemas import AVAILABLE, RESERVED, SECTION

INIT_TS = "timestamp_ntz'2023-12-31 00:00:00'"
CUT_TS = "timestamp_ntz'2024-01-16 00:00:00'"


class Tables:
    """Lazy views; every column choice reaches the parquet scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._schemas: dict[str, T.StructType] = {}

    def raw(self, name: str) -> DataFrame:
        """A given table; its footer is read for the schema only once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    @property
    def commands(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("reservation_id"),
            F.col("user_id").alias("event_id"),
            F.col("event_type").alias("section"),
            (F.floor("value").cast("int") % 4 + 1).alias("seat_count"),
            F.regexp_extract("props", r"\"k\": ([0-9]+)", 1).alias("user_id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
        )

    @property
    def inits(self) -> DataFrame:
        """Every section seen: 4 rows of 6 seats, seats 7, 14 and 21 taken."""
        sections = self.commands.select(*SECTION).distinct()
        taken = F.array(*[F.concat("section", F.lit(f"-{n}")) for n in (7, 14, 21)])
        return sections.select(
            *SECTION, F.lit(4).alias("rows"), F.lit(6).alias("seats_per_row"),
            taken.alias("initial_reserved"), F.expr(INIT_TS).alias("ts"))

    @property
    def venues(self) -> DataFrame:
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"),
            F.col("r_name").alias("address"), ((F.col("n_regionkey") + 1) * 1000).alias("capacity"))

    @property
    def events(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
            F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size")).alias("event_date"),
            (F.col("p_partkey") % 25).alias("venue_id"))

    @property
    def tickets(self) -> DataFrame:
        word = F.col("o_orderstatus")
        status: Column = F.when(word == "O", AVAILABLE).when(word == "P", RESERVED).when(word == "F", "SOLD")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event_id"),
            F.concat(F.lit("A-"), (F.col("o_orderkey") % 24 + 1).cast("string")).alias("seat_number"),
            status.alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))

    @property
    def reservations(self) -> DataFrame:
        word = F.col("event_type")
        status = F.when(word == "purchase", "CONFIRMED").when(word == "error", "CANCELLED").otherwise("PENDING")
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("event_id").alias("ticket_id"),
            F.col("user_id").cast("string").alias("user_id"), status.alias("status"),
            F.col("ts").cast("timestamp_ntz").alias("created_at"))

    @property
    def request_log(self) -> DataFrame:
        post = F.floor(F.col("value") * 3).cast("bigint")
        get = F.floor(F.col("value") * 7).cast("bigint")
        return self.raw("events").select(
            F.col("event_id").alias("request_id"), post.alias("post_ms"), get.alias("get_ms"),
            (post + get + F.col("event_id") % 100).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))

    @property
    def timed_log(self) -> DataFrame:
        """The request log with the time of each request."""
        post = F.floor(F.col("value") * 3).cast("bigint")
        get = F.floor(F.col("value") * 7).cast("bigint")
        return self.raw("events").select(
            F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (post + get).alias("processing_ms"),
            (post + get + F.col("event_id") % 100).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))

    @property
    def checked_log(self) -> DataFrame:
        """What each request's two calls returned: errors of even ids are refused, others not answered; every fiftieth stays open."""
        failed, number = F.col("event_type") == "error", F.col("event_id")
        return self.raw("events").select(
            number.alias("request_id"), F.when(failed & (number % 2 == 0), F.lit(503)).otherwise(F.lit(202)).alias("post_status"),
            F.when(failed, F.lit(504)).otherwise(F.lit(200)).alias("get_status"),
            F.when(number % 50 == 0, F.lit("PENDING")).when(number % 3 == 0, F.lit("REJECTED")).otherwise(F.lit("CONFIRMED")).alias("status"))

    @property
    def event_requests(self) -> DataFrame:
        """Event creation requests in the load client's shape, areas nested.

        Each has ``p_size % 4 + 1`` areas named from A, of ``p_size % 7`` rows (none
        for some) and ``p_size`` columns.
        """
        area = lambda i: F.struct(
            F.char((F.lit(64) + i).cast("bigint")).alias("area_id"),
            (F.col("p_size") % 7).alias("row_count"), (F.col("p_size") + i).alias("col_count"))
        areas = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), area)
        return self.raw("part").select(
            F.col("p_partkey").alias("event_id"), F.col("p_name").alias("event_name"),
            F.col("p_brand").alias("artist"), areas.alias("areas"))
