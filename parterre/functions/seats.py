"""Column expressions over seat and section names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section_key(event_id: str | Column = "event_id", section: str | Column = "section") -> Column:
    """``<event_id>-<section>``, the text key used at sinks."""
    return F.concat_ws("-", F.col(event_id) if isinstance(event_id, str) else event_id,
                       F.col(section) if isinstance(section, str) else section)


def seat_name(section: Column, number: Column) -> Column:
    return F.concat(section, F.lit("-"), number.cast("string"))


def seat_names(section: Column, first: Column, count: Column) -> Column:
    """The names of ``count`` seats from ``first`` on; empty when ``first`` is null."""
    return F.when(
        first.isNotNull() & (count > 0),
        F.transform(F.sequence(first, first + count - 1), lambda n: seat_name(section, n)),
    ).otherwise(F.array().cast("array<string>"))


def seat_number(seat: Column) -> Column:
    """The integer after the last dash, or -1 where there is none."""
    digits = F.regexp_extract(seat, r"-([0-9]+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def section_of_seat(seat: Column) -> Column:
    """The text before the first dash."""
    return F.substring_index(seat, "-", 1)


def grid_position(seat: Column) -> Column:
    """``A-7`` as ``(row, col)``: first letter counted from A, and the second dash part.

    A name whose second part is not a number has a null column.
    """
    return F.struct(
        (F.ascii(seat) - F.lit(65)).cast("int").alias("row"),
        F.get(F.split(seat, "-"), 1).try_cast("int").alias("col"),
    )


def same_text(left: Column, right: Column) -> Column:
    """Equality that ignores case."""
    return F.upper(left) == F.upper(right)
