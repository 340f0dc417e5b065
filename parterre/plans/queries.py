"""The registered queries: each operator over the whole given tables.

Every function takes the views of one data folder and returns a DataFrame whose
columns have the names and types of the SQL in :mod:`parterre.plans.oracle`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from parterre.functions import seats as S
from parterre.functions import time as TM
from parterre.operators import allocate as A
from parterre.operators import compat as C
from parterre.operators import dedup as D
from parterre.operators import integrity as V
from parterre.operators import inventory as I
from parterre.operators import relational as R
from parterre.operators import reports as G
from parterre.operators import route as RT
from parterre.operators import sketches as K
from parterre.operators import tables as T
from parterre.operators.running import sequence_number
from parterre.schemas import AVAILABLE, COMMAND, SECTION, SECTION_INIT, TICKET_STATUSES
from parterre.session import fresh_path, materialize
from parterre.sources.files import commands_from_requests, publish, read_log
from parterre.sources import wire as W
from parterre.sources.fixtures import CUT_TS, INIT_TS, Tables
from parterre.sources.history import History
from parterre.streaming import alerts as AL
from parterre.streaming.dedup import RepeatedRequests
from parterre.streaming.follow import ChangedEvents, LatestTable
from parterre.streaming.route import StreamingRoute
from parterre.streaming.stateful import StatefulRoute

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def long(name: str):
    return F.col(name).cast("bigint").alias(name)


# --- sources and keys ---------------------------------------------------------------------------


@query
def src_commands(t: Tables) -> DataFrame:
    return t.commands


@query
def src_section_init(t: Tables) -> DataFrame:
    return t.inits.withColumn("initial_reserved", F.array_join("initial_reserved", ","))


@query
def wire_completions(t: Tables) -> DataFrame:
    """Completions as they travel, after a round trip through JSON."""
    values = W.encoded(W.to_completions(A.allocate_seats(t.commands, t.inits)), F.col("reservationId"))
    return W.decoded(values, "ReservationCompletedEvent").withColumn("allocatedSeats", F.array_join("allocatedSeats", ","))


@query
def wire_states(t: Tables) -> DataFrame:
    """Free runs of each section, after its state has travelled as a status for each seat."""
    states = A.final_states(t.commands, t.inits).join(t.inits.select(*SECTION, (F.col("rows") * F.col("seats_per_row")).alias("seats")), SECTION)
    values = W.encoded(W.to_states(states, F.col("seats")), F.concat_ws("-", "eventId", "section"))
    back = W.from_states(W.decoded(values, "SectionSeatState"))
    return I.free_runs_of_state(back)


@query
def section_key(t: Tables) -> DataFrame:
    return t.commands.select("reservation_id", S.section_key().alias("section_key"))


@query
def command_sequence(t: Tables) -> DataFrame:
    narrow = t.commands.select("reservation_id", *SECTION, "ts")
    return sequence_number(narrow, SECTION, ["ts", "reservation_id"], "seq").drop("ts")


@query
def commands_of_requests(t: Tables) -> DataFrame:
    """Commands built of requests, with ids and times from outside."""
    asked = t.commands.select(F.col("reservation_id").alias("id"), "event_id", "section", "seat_count", "user_id", F.col("ts").alias("at"))
    return commands_from_requests(asked, F.col("id"), F.col("at"))


@query
def live_request_ids(t: Tables) -> DataFrame:
    """Ids drawn for live requests: are they all different, and well formed?"""
    drawn = commands_from_requests(t.commands.drop("reservation_id", "ts"))
    return drawn.agg(F.count(F.lit(1)).alias("requests"), (F.countDistinct("reservation_id") == F.count(F.lit(1))).alias("distinct_ids"),
                     F.every(F.col("reservation_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"))


@query
def seat_number(t: Tables) -> DataFrame:
    return t.tickets.select("id", S.seat_number(F.col("seat_number")).alias("number"))


@query
def epoch_round_trip(t: Tables) -> DataFrame:
    millis = TM.to_millis(F.col("ts"))
    day = F.date_format(F.col("ts"), "yyyy-MM-dd")
    return t.commands.select(
        "reservation_id", millis.alias("millis"), TM.from_millis(millis).alias("instant"),
        TM.iso_date(day).alias("day"))


# --- section set-up -----------------------------------------------------------------------------


@query
def seat_inventory(t: Tables) -> DataFrame:
    return I.seat_inventory(t.inits)


@query
def section_init_status(t: Tables) -> DataFrame:
    return I.section_init_status(t.inits)


@query
def publish_section_init(t: Tables) -> DataFrame:
    requests = t.event_requests.select("event_id", C.sections_of_areas(F.col("areas")).alias("sections"))
    inits = R.section_inits(requests)
    return inits.select(
        S.section_key().alias("section_key"), *SECTION, "rows", "seats_per_row",
        F.size("initial_reserved").alias("reserved"))


@query
def event_total_seats(t: Tables) -> DataFrame:
    requests = t.event_requests.select("event_id", C.sections_of_areas(F.col("areas")).alias("sections"))
    return R.event_total_seats(R.section_inits(requests))


@query
def sections_from_tickets(t: Tables) -> DataFrame:
    sections = R.sections_of_tickets(t.tickets)
    return sections.withColumn("initial_reserved", F.array_join("initial_reserved", ","))


# --- allocation ---------------------------------------------------------------------------------


def _results(t: Tables) -> DataFrame:
    return A.allocate_seats(t.commands, t.inits)


def _outcomes(t: Tables) -> DataFrame:
    """Results for queries that do not show users."""
    return A.allocate_seats(A.anonymous(t.commands), t.inits)


@query
def seat_allocation(t: Tables) -> DataFrame:
    return _results(t)


@query
def section_status_changelog(t: Tables) -> DataFrame:
    changes = A.status_changelog(t.commands, t.inits)
    return changes.select(S.section_key().alias("section_key"), *SECTION, "reservation_id",
                          "available_count", "status_ts")


@query
def latest_section_status(t: Tables) -> DataFrame:
    """Each status twice, the second a day later with one seat less; the later one stays."""
    first = A.status_changelog(t.commands, t.inits)
    later = F.col("status_ts") + F.expr("interval 1 day")
    version = F.explode(F.array(F.lit(0), F.lit(1)))
    twice = first.withColumn("version", version).select(
        *SECTION, "epoch", (F.col("available_count") - F.col("version")).alias("available_count"),
        F.when(F.col("version") == 1, later).otherwise(F.col("status_ts")).alias("status_ts"))
    return RT.latest_section_status(twice).select(*SECTION, "available_count", "status_ts")


@query
def seat_inventory_final(t: Tables) -> DataFrame:
    return I.seat_inventory_of_states(t.inits, A.final_states(t.commands, t.inits))


@query
def available_seats(t: Tables) -> DataFrame:
    maps = I.seat_maps_of_states(t.inits, A.final_states(t.commands, t.inits))
    names = I.available_seat_list(F.col("seat_statuses"))
    return maps.select(*SECTION, "available_count", F.array_join(names, ",").alias("available_seats"))


@query
def free_runs(t: Tables) -> DataFrame:
    return I.free_runs_of_state(A.final_states(t.commands, t.inits))


@query
def first_fit_start(t: Tables) -> DataFrame:
    sizes = t.commands.select(*SECTION, "seat_count").distinct()
    return I.first_fit_start(A.final_states(t.commands, t.inits), sizes)


# --- routing ------------------------------------------------------------------------------------


def _judged_batches(t: Tables) -> DataFrame:
    """Commands before the cut, when no status is known yet, and those after it against the availability left by
    the first ones, with section ``signup`` not yet seen by the status table."""
    early = t.commands.where(F.col("ts") < F.expr(CUT_TS))
    late = t.commands.where(F.col("ts") >= F.expr(CUT_TS))
    left = A.final_states(early, t.inits).where(F.col("section") != "signup")
    unjudged = early.withColumns({"known_available": F.lit(None).cast("int"), "enough": F.lit(True)})
    return unjudged.unionByName(RT.with_verdict(late, left))


@query
def prefilter_accepted(t: Tables) -> DataFrame:
    kept = RT.accepted(_judged_batches(t))
    return kept.select(S.section_key().alias("section_key"), *kept.columns)


@query
def prefilter_rejected(t: Tables) -> DataFrame:
    refused = A.with_seat_names(RT.rejected(_judged_batches(t)))
    return refused.select("reservation_id", *SECTION, "seat_count", "user_id", "status",
                          F.size("allocated_seats").alias("seats"), "completed_ts")


@query
def commands_with_status_as_of(t: Tables) -> DataFrame:
    """Each command with the seats its section had left just before it."""
    changes = A.status_changelog(t.commands, t.inits)
    return RT.with_status_as_of(t.commands.drop("user_id"), changes)


@query
def reservation_routing(t: Tables) -> DataFrame:
    """Both batches end to end: pre-filter, allocate on the carried state, complete."""
    route = RT.Route()
    first = route.run(t.commands.where(F.col("ts") < F.expr(CUT_TS)), t.inits)
    second = route.run(t.commands.where(F.col("ts") >= F.expr(CUT_TS)))
    return first.unionByName(second).drop("epoch")


def _second_inits(t: Tables) -> DataFrame:
    """At the cut, sections of even event numbers are set up anew, with two rows."""
    return t.inits.where(F.col("event_id") % 2 == 0).withColumns({"rows": F.lit(2), "ts": F.expr(CUT_TS)})


def _first_inits(t: Tables) -> DataFrame:
    """All sections but those of every fifth event, which are never set up at first."""
    return t.inits.where(F.col("event_id") % 5 != 0)


@query
def seat_allocation_reinit(t: Tables) -> DataFrame:
    return A.allocate_seats(t.commands, _first_inits(t).unionByName(_second_inits(t))).drop("epoch")


@query
def reservation_routing_reinit(t: Tables) -> DataFrame:
    """Two batches, the second with set-ups of its own; who was turned away where is left out."""
    route = RT.Route()
    first = route.run(t.commands.where(F.col("ts") < F.expr(CUT_TS)), _first_inits(t))
    second = route.run(t.commands.where(F.col("ts") >= F.expr(CUT_TS)), _second_inits(t))
    return first.unionByName(second).drop("epoch", "prefiltered")


COMPLETED_FEED = StructType([
    StructField("reservation_id", StringType()), StructField("event_id", LongType()), StructField("section", StringType()),
    StructField("seat_count", IntegerType()), StructField("user_id", StringType()), StructField("status", StringType()),
    StructField("allocated_seats", StringType()), StructField("completed_ts", TimestampNTZType())])


def completed_feed(t: Tables) -> DataFrame:
    """Each completed result twice: first as pending, a second later as it ended."""
    ended = A.with_seat_names(_results(t))
    version = F.explode(F.array(F.lit(0), F.lit(1)))
    last = F.col("version") == 1
    return ended.withColumn("version", version).select(
        "reservation_id", *SECTION, "seat_count", "user_id",
        F.when(last, F.col("status")).otherwise(F.lit("PENDING")).alias("status"),
        F.when(last, F.array_join("allocated_seats", ",")).otherwise(F.lit("")).alias("allocated_seats"),
        F.when(last, F.col("completed_ts") + F.expr("interval 1 second"))
        .otherwise(F.col("completed_ts")).alias("completed_ts"))


@query
def reservation_table(t: Tables) -> DataFrame:
    return T.latest_by_key(completed_feed(t), ["reservation_id"], ["completed_ts"])


@query
def reservation_lookup(t: Tables) -> DataFrame:
    """Ask for every order key as a reservation id; many have no reservation, and every tenth was answered twice."""
    asked = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("asked_id"))
    answers = A.with_seat_names(_results(t)).select(
        "reservation_id", *SECTION, "seat_count", "user_id", "status",
        F.array_join("allocated_seats", ",").alias("allocated_seats"),
        TM.from_millis(TM.to_millis(F.col("completed_ts"))).alias("created_at"))
    earlier = answers.where(F.col("reservation_id").cast("bigint") % 10 == 0).withColumns(
        {"status": F.lit("PENDING"), "created_at": F.col("created_at") - F.expr("interval 1 second")})
    table = T.latest_by_key(answers.unionByName(earlier), ["reservation_id"], ["created_at"])
    return T.lookup(asked, table, "reservation_id", "asked_id")


@query
def events_with_changes(t: Tables) -> DataFrame:
    shouted = _outcomes(t).withColumn("status", F.lower("status"))
    return R.events_with_changes(shouted)


@query
def status_feed(t: Tables) -> DataFrame:
    """Availability updates of the events some confirmed reservation has changed."""
    outcome = materialize(A.replay(A.anonymous(t.commands), t.inits, with_status=True), "feed-source")
    changed = R.events_with_changes(A.results_of(outcome))
    feed = T.find_in(A.status_of(outcome), changed, ["event_id"])
    return feed.select("event_id", "section", "available_count", "status_ts")


# --- relational ---------------------------------------------------------------------------------


@query
def venues_all(t: Tables) -> DataFrame:
    return t.venues


@query
def events_all(t: Tables) -> DataFrame:
    return R.event_view(t.events, t.venues)


@query
def venue_by_id(t: Tables) -> DataFrame:
    asked = t.events.select(F.col("venue_id").alias("asked_id")).distinct()
    return T.lookup(asked, t.venues, "id", "asked_id")


@query
def event_by_id(t: Tables) -> DataFrame:
    """Every customer of an order asks for the event of its number; some do not exist."""
    asked = t.raw("customer").select((F.col("c_custkey") * 2).alias("asked_id")).distinct()
    return T.lookup(asked, R.event_view(t.events, t.venues), "id", "asked_id")


@query
def ticket_by_id(t: Tables) -> DataFrame:
    asked = t.reservations.select((F.col("ticket_id") * 2).alias("asked_id"))
    return T.lookup(asked, R.ticket_view(t.tickets, t.events), "id", "asked_id")


@query
def tickets_by_event(t: Tables) -> DataFrame:
    """Tickets of the events that some customer asks for; many of these have none."""
    return R.ticket_view(T.find_in(t.tickets, _asked_events(t), ["event_id"]), t.events)


def _asked_events(t: Tables) -> DataFrame:
    return t.raw("customer").select((F.col("c_custkey") * 3).alias("event_id"))


@query
def tickets_available(t: Tables) -> DataFrame:
    available = T.find_by(t.tickets, status=AVAILABLE)
    return R.ticket_view(T.find_in(available, _asked_events(t), ["event_id"]), t.events)


@query
def tickets_by_seats(t: Tables) -> DataFrame:
    seat = F.concat(F.lit("A-"), F.col("seat_count").cast("string"))
    wanted = t.commands.select("event_id", seat.alias("seat_number"))
    return T.find_in(t.tickets, wanted, ["event_id", "seat_number"])


@query
def reservation_by_ticket_user(t: Tables) -> DataFrame:
    wanted = t.commands.select(F.col("reservation_id").cast("bigint").alias("ticket_id"), "user_id")
    return T.find_in(t.reservations, wanted, ["ticket_id", "user_id"]).select(*t.reservations.columns)


@query
def ticket_has_active_reservation(t: Tables) -> DataFrame:
    active = t.reservations.where(F.col("status") != "CANCELLED")
    flagged = T.exists_flag(t.tickets, active, {"id": "ticket_id"}, "has_active")
    return flagged.select("id", "has_active")


@query
def reservations_expanded(t: Tables) -> DataFrame:
    return R.reservation_view(t.reservations, t.tickets, t.events, t.venues)


_ORPHAN = 1_000_000_000


@query
def ingest_events(t: Tables) -> DataFrame:
    """Every tenth event names a venue that does not exist."""
    strayed = F.when(F.col("id") % 10 == 0, F.col("venue_id") + _ORPHAN).otherwise(F.col("venue_id"))
    checked = R.check_parent(t.events.withColumn("venue_id", strayed), t.venues, "venue_id")
    return checked.select("id", "name", "venue_id", R.verdict(F.col("parent_known")).alias("verdict"))


@query
def ingest_tickets(t: Tables) -> DataFrame:
    """Every tenth ticket names an unknown event, every thirteenth has no known status."""
    strayed = F.when(F.col("id") % 10 == 0, F.col("event_id") + _ORPHAN).otherwise(F.col("event_id"))
    word = F.when(F.col("id") % 13 == 0, F.lit("LOST")).otherwise(F.col("status"))
    incoming = t.tickets.withColumn("event_id", strayed).withColumn("status", word)
    checked = R.check_parent(incoming, t.events, "event_id")
    outcome = R.verdict(F.col("parent_known"), F.col("status"), TICKET_STATUSES)
    return checked.select("id", "event_id", "status", "price", outcome.alias("verdict"))


# --- load client vocabulary ---------------------------------------------------------------------


@query
def ingest_tickets_twice(t: Tables) -> DataFrame:
    """The verdicts of :func:`ingest_tickets` read back after two batches, each ingested twice."""
    folder = fresh_path(t.spark, "ingest")
    checked = ingest_tickets(t)
    for batch, rows in {"even": checked.where("id % 2 = 0"), "odd": checked.where("id % 2 = 1")}.items():
        for _ in range(2):
            R.ingest_batch(rows, folder, batch)
    schema = StructType([f for f in checked.schema if f.name != "verdict"])
    taken = R.ingested(t.spark, folder, schema).withColumn("verdict", F.lit("accepted"))
    return taken.unionByName(R.ingested(t.spark, folder, schema, accepted=False))


@query
def compat_sections(t: Tables) -> DataFrame:
    sections = C.sections_of_areas(F.col("areas"))
    return t.event_requests.select("event_id", "event_name", "artist", F.explode(sections).alias("s")).select(
        "event_id", "event_name", "artist", "s.section", "s.rows", "s.seats_per_row")


@query
def compat_capacity(t: Tables) -> DataFrame:
    return t.event_requests.select(
        "event_id", "event_name", C.capacity_of_areas(F.col("areas")).alias("capacity"))


@query
def compat_reservations(t: Tables) -> DataFrame:
    seen = C.compat_results(A.with_seat_names(_results(t)))
    text = lambda part: F.array_join(F.col(f"seats.{part}").cast("array<string>"), ",")
    return seen.select(
        "reservation_id", "user_id", "event_id", "area_id", "num_of_seats", "state",
        F.size("seats").alias("seats"), text("row").alias("seat_rows"), text("col").alias("seat_cols"))


@query
def compat_resolve_event(t: Tables) -> DataFrame:
    """Reservation requests by event name; every tenth name was never registered."""
    names = t.events.select("id", "name")
    named = t.commands.join(names, F.col("event_id") == F.col("id"), "left").select(
        "reservation_id", F.col("section").alias("area_id"), F.col("seat_count").alias("num_of_seats"),
        F.when(F.col("reservation_id").cast("bigint") % 10 == 0, F.lit("never registered"))
        .otherwise(F.col("name")).alias("event_name"))
    registered = names.select(F.col("name").alias("event_name"), F.col("id").alias("event_id"))
    return C.reservation_request(C.resolve_event_names(named, registered, ["event_id"])).withColumn(
        "accepted", F.col("event_id").isNotNull())


@query
def compat_resolve_event_as_of(t: Tables) -> DataFrame:
    """Requests by name, at their time; an event registers its name on the day its number gives, names may be taken over."""
    word = lambda name: F.element_at(F.split(name, " "), 1)
    registered = t.events.select(
        word("name").alias("event_name"), F.col("id").alias("event_id"),
        (F.expr(INIT_TS) + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("registered_ts"))
    named = t.commands.join(t.events.select(F.col("id").alias("event_id"), word("name").alias("event_name")), "event_id", "left").select(
        "reservation_id", "section", "seat_count", "event_name", "ts")
    return C.resolve_event_names_as_of(named, registered).withColumn("accepted", F.col("event_id").isNotNull())


# --- reports ------------------------------------------------------------------------------------


@query
def outcome_counts(t: Tables) -> DataFrame:
    log = t.request_log.select(F.col("request_id").cast("string").alias("reservation_id"), "ok")
    return G.outcome_counts(_outcomes(t).join(log, "reservation_id", "inner"))


@query
def seats_per_section(t: Tables) -> DataFrame:
    return G.seats_per_section(_outcomes(t))


@query
def latency_percentiles(t: Tables) -> DataFrame:
    return G.latency_percentiles(t.request_log)


@query
def slo_report(t: Tables) -> DataFrame:
    return G.slo_report(t.request_log)


@query
def slo_report_large(t: Tables) -> DataFrame:
    return G.slo_report(t.request_log, G.THRESHOLDS["large"])


@query
def latency_percentiles_approx(t: Tables) -> DataFrame:
    """Percentiles from hourly sketches: are the ranks of what they return within the bound, by an exact count?"""
    log = t.timed_log.where("ok")
    measures = {c: F.col(c) for c in ("processing_ms", "latency_ms")}
    sketches = materialize(K.hourly_sketches(log, measures), "hourly-sketches")
    found = materialize(K.merged_percentiles(sketches, [0.5, 0.95, 0.99]), "approximate")
    values = log.unpivot(["request_id"], list(measures), "measure", "value").select("measure", "value")
    return K.rank_errors(values, found).select("measure", "point", "n", (F.col("rank_error") <= K.RANK_ERROR).alias("within_bound"))


@query
def check_report(t: Tables) -> DataFrame:
    return G.check_report(t.checked_log)


@query
def request_alerts(t: Tables) -> DataFrame:
    return AL.alert_windows(t.timed_log, "1 hour")


# --- integrity ----------------------------------------------------------------------------------


@query
def duplicate_seats(t: Tables) -> DataFrame:
    return V.duplicate_seats(_outcomes(t))


@query
def duplicate_seats_planted(t: Tables) -> DataFrame:
    """The results plus a copy of the confirmed row with the lowest id."""
    results = materialize(_outcomes(t), "planted-source")
    lowest = results.where("status = 'CONFIRMED'").agg(
        F.min_by(F.struct(*results.columns), F.col("reservation_id").cast("bigint")).alias("r")).select("r.*")
    copy = lowest.withColumn("reservation_id", F.lit("copied"))
    return V.duplicate_seats(results.unionByName(copy))


@query
def allocation_violations(t: Tables) -> DataFrame:
    return V.allocation_violations(A.with_seat_names(_outcomes(t))).select("reservation_id", "problem")


@query
def allocation_violations_planted(t: Tables) -> DataFrame:
    """Every fifth result is spoiled in a way its id decides."""
    named = A.with_seat_names(_outcomes(t))
    number = F.col("reservation_id").cast("bigint")
    seats, sold = F.col("allocated_seats"), F.size("allocated_seats") > 0
    spoiled = (
        F.when((number % 5 == 0) & ~sold, F.array(F.concat_ws("-", "section", F.lit("1"))))
        .when((number % 20 == 0) & sold, F.slice(seats, 2, F.size(seats)))
        .when((number % 20 == 5) & sold, F.transform(seats, lambda s: F.concat(F.lit("B-"), s)))
        .when((number % 20 == 10) & (F.size(seats) > 1), F.reverse(seats))
        .otherwise(seats))
    status = F.when(number % 20 == 15, F.lit("LOST")).otherwise(F.col("status"))
    return V.allocation_violations(named.withColumns({"allocated_seats": spoiled, "status": status})).select("reservation_id", "problem")


@query
def inventory_balance(t: Tables) -> DataFrame:
    outcome = materialize(A.replay(A.anonymous(t.commands), t.inits, with_states=True), "balance-source")
    return V.inventory_balance(t.inits, A.results_of(outcome), A.states_of(outcome, F.expr(INIT_TS)))


@query
def inventory_balance_reinit(t: Tables) -> DataFrame:
    """With a second set-up of some sections, and the results of every ninth event missing: those don't balance."""
    inits = t.inits.unionByName(_second_inits(t))
    outcome = materialize(A.replay(A.anonymous(t.commands), inits, with_states=True), "balance-source")
    results = A.results_of(outcome).where(F.col("event_id") % 9 != 0)
    return V.inventory_balance(inits, results, A.states_of(outcome, F.expr(INIT_TS)))


@query
def unresolved_commands(t: Tables) -> DataFrame:
    return V.unresolved_commands(t.commands, _outcomes(t))


@query
def unresolved_commands_planted(t: Tables) -> DataFrame:
    """Every seventh answer is missing, every eleventh is there twice, every thirteenth is not final."""
    number = F.col("reservation_id").cast("bigint")
    times = F.when(number % 7 == 0, F.lit(0)).when(number % 11 == 0, F.lit(2)).otherwise(F.lit(1))
    answers = _outcomes(t).withColumn("status", F.when(number % 13 == 0, F.lit("PENDING")).otherwise(F.col("status")))
    once = answers.where(times > 0)
    return V.unresolved_commands(t.commands, once.unionByName(once.where(times > 1)))


@query
def user_dedup(t: Tables) -> DataFrame:
    """One request a user within an hour; the others are answered by it."""
    return D.repeated_requests(t.commands, ["user_id"])


@query
def reservation_history(t: Tables) -> DataFrame:
    """Results appended in two batches, the first one twice; days 90 days old are in the archive."""
    results = materialize(A.allocate_seats(t.commands, t.inits).drop("epoch"), "history-source")
    history = History(t.spark, fresh_path(t.spark, "history"), results.schema)
    early = F.col("completed_ts") < F.expr(CUT_TS)
    history.append(results.where(early), "first")
    history.archive(dt.date(2024, 4, 10))
    for batch, rows in {"first": early, "second": ~early}.items():
        history.append(results.where(rows), batch)
    return history.read()


# --- streams: the same results by way of files, micro-batches and checkpoints ---------------------


def _stream_route(t: Tables, shed: bool) -> StreamingRoute:
    """Two runs of one route: commands up to the cut, then, resumed, the rest."""
    folder = fresh_path(t.spark, "stream-route")
    route = StreamingRoute(t.spark, folder, shed=shed)
    cut = F.expr(CUT_TS)
    publish(t.inits, f"{folder}/in/inits")
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        publish(t.commands.where(part), f"{folder}/in/commands")
        route.run(read_log(t.spark, f"{folder}/in/commands", COMMAND, stream=True),
                  read_log(t.spark, f"{folder}/in/inits", SECTION_INIT, stream=True))
    return route


@query
def stream_seat_allocation(t: Tables) -> DataFrame:
    return _stream_route(t, shed=False).completed().drop("prefiltered")


def _stateful_route(t: Tables, shed: bool) -> StatefulRoute:
    """As :func:`_stream_route`, with the states in Spark's state store; the sections' first states are given, not streamed."""
    folder = fresh_path(t.spark, "stateful-route")
    nothing = t.commands.where(F.lit(False))
    route = StatefulRoute(t.spark, folder, shed=shed, initial=A.final_states(nothing, t.inits))
    cut = F.expr(CUT_TS)
    publish(t.inits.limit(0), f"{folder}/in/inits")
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        publish(t.commands.where(part), f"{folder}/in/commands")
        route.run(read_log(t.spark, f"{folder}/in/commands", COMMAND, stream=True),
                  read_log(t.spark, f"{folder}/in/inits", SECTION_INIT, stream=True))
    return route


@query
def stream_seat_allocation_stateful(t: Tables) -> DataFrame:
    return _stateful_route(t, shed=False).completed().drop("prefiltered")


@query
def stream_prefilter(t: Tables) -> DataFrame:
    """Where each command was decided, with the pre-filter in front of the allocator."""
    return _stream_route(t, shed=True).completed().drop("epoch")


@query
def stream_user_dedup(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "stream-dedup")
    stream = RepeatedRequests(t.spark, folder, ["user_id"])
    cut = F.expr(CUT_TS)
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        publish(t.commands.where(part), f"{folder}/in")
        stream.run(read_log(t.spark, f"{folder}/in", COMMAND, stream=True))
    return stream.read()


@query
def stream_alerts(t: Tables) -> DataFrame:
    """Alerts of the hours that the watermark has passed."""
    folder = fresh_path(t.spark, "stream-alerts")
    alerts = AL.Alerts(t.spark, folder, "1 hour")
    log, cut = t.timed_log, F.expr(CUT_TS)
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        publish(log.where(part), f"{folder}/in")
        alerts.run(read_log(t.spark, f"{folder}/in", log.schema, stream=True))
    return alerts.read()


def _completed_in_two_runs(t: Tables, follower: LatestTable | ChangedEvents, folder: str) -> None:
    feed = materialize(completed_feed(t), "completed-feed")
    for part in (F.col("status") == "PENDING", F.col("status") != "PENDING"):
        publish(feed.where(part), f"{folder}/in")
        follower.run(read_log(t.spark, f"{folder}/in", COMPLETED_FEED, stream=True))


@query
def stream_reservation_table(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "stream-table")
    table = LatestTable(t.spark, folder, COMPLETED_FEED, ["reservation_id"], ["completed_ts"])
    _completed_in_two_runs(t, table, folder)
    return table.read()


@query
def stream_events_with_changes(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "stream-changes")
    changes = ChangedEvents(t.spark, folder)
    _completed_in_two_runs(t, changes, folder)
    return changes.read().select("event_id").distinct()
