"""Percentiles from stored sketches: one a measure and hour, merged over any range of hours.

A sketch has a fixed size whatever the number of values, and merging loses
nothing beyond its own error, so a day, a month or a service is asked without
going back to the log. Sketches are aggregates, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch. The rank of what it returns is off by at most ``RANK_ERROR`` of all values (99 % of the time).
SIZE, RANK_ERROR = 2048, 0.002


def hourly_sketches(log: DataFrame, measures: dict[str, Column], time: str = "ts", size: int = SIZE) -> DataFrame:
    """(hour, measure, n, sketch) of whole-number measures; null values don't count."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("bigint").alias("value")) for n, c in measures.items()])).alias("m")
    rows = log.select(F.date_trunc("hour", time).cast("timestamp_ntz").alias("hour"), values).select("hour", "m.*").where("value is not null")
    return rows.groupBy("hour", "measure").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("value", F.lit(size)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, points: Sequence[float], by: Sequence[str] = ("measure",)) -> DataFrame:
    """One row for each group of ``by`` and point: the number of values, and one whose rank is near ``point``."""
    whole = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    asked = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias("milliseconds"))
                                for p in points])).alias("q")
    return whole.select(*by, "n", asked).select(*by, "n", "q.*")


def rank_errors(values: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (measure, point, n, milliseconds) with ``rank_error``: how far the ranks of each value are from its point, exactly.

    ``values`` has (measure, value). One pass: a row per value and point, combined at once.
    """
    joined = values.join(F.broadcast(found), "measure")  # a row for each measure and point
    sides = joined.groupBy(*found.columns).agg(
        F.count_if(F.col("value") < F.col("milliseconds")).alias("below"), F.count_if(F.col("value") <= F.col("milliseconds")).alias("through"))
    low, high = F.col("below") / F.col("n"), F.col("through") / F.col("n")
    return sides.select(*found.columns, F.greatest(low - F.col("point"), F.col("point") - high, F.lit(0.0)).alias("rank_error"))
