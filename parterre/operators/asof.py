"""As-of join: each row with the state of its key at the row's time.

Both sides are laid on one time line per key, and the last value seen is carried
along. That is one shuffle of both sides by key and one sorted scan, whatever the
number of right rows a left row could match; a range condition in a join would
pair them all. A key with more rows than a task should hold is cut into slices of
time (:mod:`parterre.operators.running`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.operators.running import running_lasts


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str],
    *, before: bool = False, ties: list[str | Column] | None = None,
) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` for its ``keys`` at its time, or null; one row each.

    A right row counts from its time on, or after it with ``before``. Of several at one time the last in ``ties`` counts,
    which should order them fully. Null keys and times match nothing. ``values`` may share no name with a left column.
    """
    known = right.where(F.col(right_time).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    # With ``before``, rows of one time come after the left rows of that time.
    known = known.select(
        *keys, F.col(right_time).alias("as_of_time"), F.lit(2 if before else 0).alias("as_of_side"),
        F.struct(*(ties or [F.lit(0)])).alias("as_of_tie"), F.struct(*values).alias("as_of_value"))
    asking = left.select(
        *keys, F.col(left_time).alias("as_of_time"), F.lit(1).alias("as_of_side"),
        F.struct(*[c for c in left.columns if c not in keys]).alias("as_of_row"))
    line = known.unionByName(asking, allowMissingColumns=True)
    carried = running_lasts(line, keys, ["as_of_time", "as_of_side", "as_of_tie"], {"as_of_value": F.col("as_of_value")})
    found = carried.where(F.col("as_of_side") == 1).select(*keys, "as_of_row.*", *[F.col(f"as_of_value.{v}").alias(v) for v in values])
    return found.select(*left.columns, *values)
