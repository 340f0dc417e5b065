"""Epoch milliseconds and session-independent timestamps.

Times are kept as TIMESTAMP_NTZ holding UTC wall-clock time, so that results
do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def from_millis(millis: Column) -> Column:
    return F.timestamp_add("MILLISECOND", millis, F.expr(_EPOCH))


def to_millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), ts)


def iso_date(text: Column) -> Column:
    """A date from ``yyyy-MM-dd`` text, null where it is not one."""
    return text.try_cast("date")
