"""Finding keys whose rows would overload one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.session import HEAVY_KEY_ROWS, int_setting, materialize, single_task_bytes


# Rows from outside Spark's sources are said to have the largest size there is, and joins multiply it.
_UNKNOWN_BYTES = 1 << 62


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's own size estimate, the figure behind automatic broadcasts; None where it has none.

    A join multiplies the sizes of its sides unless one is known to be unique, so ask before joining.
    """
    plan = getattr(df, "_jdf", None)
    size = None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size is None or size >= _UNKNOWN_BYTES else size


def heavy_keys(df: DataFrame, keys: list[str], size: int | None = None) -> DataFrame | None:
    """The keys with more than ``parterre.heavyKeyRows`` rows, with their counts.

    ``None`` when there are none, or when the input is too small to hold one;
    ``size`` is its estimated size if known from before a join. The
    count reads the key columns only and combines before its shuffle. At most
    rows / heavyKeyRows keys can qualify.
    """
    spark = df.sparkSession
    size = estimated_bytes(df) if size is None else size
    if size is not None and size <= single_task_bytes(spark):
        return None
    limit = int_setting(spark, HEAVY_KEY_ROWS)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    heavy = materialize(counts.where(F.col("key_rows") > limit), "heavy-keys")
    return None if heavy.isEmpty() else heavy


def split_heavy(df: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as (ordinary rows, rows of heavy keys).

    ``heavy`` is a written table, so Catalyst knows its size: it is broadcast and
    nothing is shuffled, unless it is too large for that.
    """
    wanted = heavy.select(*keys)
    return df.join(wanted, keys, "left_anti"), df.join(wanted, keys, "left_semi")
