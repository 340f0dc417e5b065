"""Seat reservations as Spark jobs: allocation, routing, lookups, reports, streams."""

from parterre.operators.allocate import allocate_seats, final_states, replay, status_changelog, with_seat_names
from parterre.operators.route import Route, latest_section_status, prefilter
from parterre.operators.tables import find_by, find_in, latest_by_key, lookup

__all__ = [
    "Route", "allocate_seats", "final_states", "find_by", "find_in", "latest_by_key", "latest_section_status",
    "lookup", "prefilter", "replay", "status_changelog", "with_seat_names",
]
