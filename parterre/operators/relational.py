"""Venues, events, tickets and reservations: projections, joins, ingest."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.functions.seats import same_text, section_of_seat
from parterre.operators.tables import exists_flag
from parterre.schemas import AVAILABLE, CONFIRMED, SECTION
from parterre.session import materialize, scratch


def event_view(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with their venue flattened; the seat total is known at creation only."""
    venue = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    return events.join(venue, "venue_id", "inner").select(
        "id", "name", "description", "event_date", "venue_id", "venue_name",
        F.lit(None).cast("int").alias("total_seats"))


def ticket_view(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Tickets with their event flattened."""
    event = events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"))
    return tickets.join(event, "event_id", "inner").select(
        "id", "event_id", "event_name", "seat_number", "status", "price")


def reservation_view(reservations: DataFrame, tickets: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """Reservations with ticket, event and venue; each table is joined once."""
    ticket = tickets.select(F.col("id").alias("ticket_id"), "event_id", "seat_number",
                            F.col("status").alias("ticket_status"), "price")
    event = event_view(events, venues).select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "event_date", "venue_id", "venue_name")
    return reservations.join(ticket, "ticket_id", "inner").join(event, "event_id", "inner").select(
        "id", "ticket_id", "user_id", "status", "created_at", "event_id", "event_name", "seat_number",
        "ticket_status", "price", "event_date", "venue_id", "venue_name")


def section_inits(requests: DataFrame, sections: str = "sections") -> DataFrame:
    """Event requests with nested sections as section set-ups with nothing reserved."""
    return requests.select("event_id", F.explode(sections).alias("s")).select(
        "event_id", F.col("s.section").alias("section"), F.col("s.rows").alias("rows"),
        F.col("s.seats_per_row").alias("seats_per_row"), F.array().cast("array<string>").alias("initial_reserved"))


def event_total_seats(inits: DataFrame) -> DataFrame:
    seats = F.col("rows").cast("bigint") * F.col("seats_per_row")
    return inits.groupBy("event_id").agg(F.sum(seats).alias("total_seats"))


def sections_of_tickets(tickets: DataFrame) -> DataFrame:
    """One single-row section set-up per ticket section, as many seats as tickets.

    Tickets are combined per seat first; the array then holds each seat of a
    section that is not available once.
    """
    per_seat = tickets.groupBy("event_id", "seat_number").agg(
        F.count(F.lit(1)).alias("tickets"), F.bool_or(F.col("status") != AVAILABLE).alias("taken"))
    per_seat = per_seat.withColumn("section", section_of_seat(F.col("seat_number")))
    return per_seat.groupBy(*SECTION).agg(
        F.lit(1).alias("rows"), F.sum("tickets").cast("int").alias("seats_per_row"),
        F.array_sort(F.collect_list(F.when(F.col("taken"), F.col("seat_number")))).alias("initial_reserved"))


def events_with_changes(results: DataFrame) -> DataFrame:
    """Events whose availability a confirmed reservation has changed."""
    return results.where(same_text(F.col("status"), F.lit(CONFIRMED))).select("event_id").distinct()


def check_parent(records: DataFrame, parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """``records`` with ``parent_known``; one pass for both accepted and refused."""
    return exists_flag(records, parents, {fk: pk}, "parent_known")


def verdict(parent_known: Column, words: Column | None = None, admitted: list[str] | None = None) -> Column:
    """Why an incoming record is refused, or ``accepted``."""
    reason = F.when(~parent_known, F.lit("unknown parent"))
    if words is not None:
        reason = reason.when(words.isNull() | ~words.isin(admitted or []), F.lit("invalid status"))
    return reason.otherwise(F.lit("accepted"))


def ticket_records(requests: DataFrame) -> DataFrame:
    """New tickets of requests (id, event_id, seat_number, price): always available."""
    return requests.select("id", "event_id", "seat_number", F.lit(AVAILABLE).alias("status"), "price")


def ingest(checked: DataFrame, table_path: str, refused_path: str) -> None:
    """Append the records whose ``verdict`` is accepted, and set the others aside. The input is evaluated once."""
    good = F.col("verdict") == "accepted"
    with scratch(checked.sparkSession):
        seen = materialize(checked, "ingest")
        seen.where(good).drop("verdict").write.mode("append").parquet(table_path)
        seen.where(~good).write.mode("append").parquet(refused_path)


def ingest_batch(checked: DataFrame, folder: str, batch: str) -> None:
    """Accepted and refused records of one batch, in one pass and repeatable.

    One job writes both below ``batch=<batch>``, apart by partition. Ingesting a batch again replaces what it wrote before,
    whatever became of it, so a retry leaves the tables as they are.
    """
    good = F.coalesce(F.col("verdict") == "accepted", F.lit(False))
    checked.withColumn("accepted", good).write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={quote(batch, safe='')}")


def ingested(spark: SparkSession, folder: str, schema: T.StructType, accepted: bool = True) -> DataFrame:
    """What was ingested below ``folder``: accepted records, or refused ones with their verdict. Only that part is read."""
    held = T.StructType([*schema, T.StructField("verdict", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("accepted", T.BooleanType())])
    found = spark.read.schema(held).parquet(folder).where(F.col("accepted") == F.lit(accepted)).drop("accepted", "batch")
    return found.drop("verdict") if accepted else found
