"""Running aggregates over ordered groups of any size.

A Spark window holds each group in one task. For ordinary groups that is the
best plan and it is the one used. A heavy group is cut into ordered slices by a
range partitioning on its sort order; every slice is scanned on its own, and the
totals of the slices before it are added. The result is that of the window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parterre.operators.skew import heavy_keys, split_heavy
from parterre.session import HEAVY_KEY_ROWS, int_setting, materialize

SLICE = "order_slice"
_TIE = "order_tie"


def slice_ordered(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Add ``order_slice``: numbers that rise with (keys, order), few rows each.

    Rows that agree in every order column are told apart by the input partition
    they come from, so that many copies of one row do not end in one slice.
    """
    # Four slices in what one task may hold: short tasks, little to redo.
    slices = max(2, -(-4 * rows // int_setting(df.sparkSession, HEAVY_KEY_ROWS)))
    tied = df.withColumn(_TIE, F.spark_partition_id())
    ranged = tied.repartitionByRange(slices, *keys, *order, _TIE)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), "ordered-slices")


def running_over_slices(
    sliced: DataFrame,
    keys: list[str],
    order: list[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    *,
    sparse: bool = False,
) -> DataFrame:
    """Running sums and last non-null values on a table from :func:`slice_ordered`.

    The totals carried from slice to slice have one row per key and slice. They
    are written first, so that Catalyst knows their size when it picks the join.
    With ``sparse``, few slices change a value: the others take what is carried
    to them and are neither shuffled nor sorted.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    position = [F.col(c) for c in [*order, _TIE]]
    within = Window.partitionBy(*keys, SLICE).orderBy(*position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)

    changes = F.lit(False)
    for column in sums.values():
        changes = changes | (column != 0)
    for column in lasts.values():
        changes = changes | column.isNotNull()
    totals = sliced.groupBy(*keys, SLICE).agg(
        F.count_if(changes).alias("changes"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.struct(*position))).alias(n) for n, c in lasts.items()],
    )
    carried = materialize(totals.select(
        *keys, SLICE, "changes",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"carried_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"carried_{n}") for n in lasts],
    ), "carried-totals")
    # An output may replace the input column it is computed from.
    kept = [c for c in sliced.columns if c not in sums and c not in lasts]

    def scanned(rows: DataFrame) -> DataFrame:
        local = rows.select(
            "*",
            *[F.sum(c).over(within).alias(f"local_{n}") for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(within).alias(f"local_{n}") for n, c in lasts.items()])
        return local.select(
            *kept,
            *[(F.col(f"carried_{n}") + F.col(f"local_{n}")).alias(n) for n in sums],
            *[F.coalesce(F.col(f"local_{n}"), F.col(f"carried_{n}")).alias(n) for n in lasts])

    joined = sliced.join(carried, [*keys, SLICE], "inner")
    if not sparse:
        return scanned(joined)
    untouched = joined.where(F.col("changes") == 0).select(
        *kept, *[F.col(f"carried_{n}").alias(n) for n in [*sums, *lasts]])
    return scanned(joined.where(F.col("changes") > 0)).unionByName(untouched)


def first_in_slices(
    sliced: DataFrame, keys: list[str], order: list[str], bound: Column
) -> tuple[DataFrame, DataFrame]:
    """Split each key's rows into its first ``bound`` in ``order``, and all others.

    ``bound`` is the same for all rows of a key. Counts per slice settle most
    slices as a whole; only where the bound falls inside a slice are its rows
    ranked.
    """
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("rows_here"), F.max(bound).alias("bound"))
    room = F.col("bound") - F.coalesce(F.sum("rows_here").over(earlier), F.lit(0))
    rooms = materialize(counts.select(*keys, SLICE, "rows_here", room.alias("room")), "slice-rooms")
    fate = F.when(F.col("room") <= 0, "out").when(F.col("room") >= F.col("rows_here"), "in").otherwise("edge")
    helpers = ["rows_here", "room", "fate"]
    placed = materialize(sliced.join(rooms, [*keys, SLICE], "inner").withColumn("fate", fate), "placed")

    rank = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order, _TIE))
    edge = placed.where(F.col("fate") == "edge").withColumn("within", rank <= F.col("room"))
    inside = placed.where(F.col("fate") == "in").drop(*helpers).unionByName(
        edge.where(F.col("within")).drop("within", *helpers))
    beyond = placed.where(F.col("fate") == "out").drop(*helpers).unionByName(
        edge.where(~F.col("within")).drop("within", *helpers))
    return inside.select(*sliced.columns), beyond.select(*sliced.columns)


def drop_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, _TIE)


def heavy_rows(heavy: DataFrame) -> int:
    return heavy.agg(F.sum("key_rows")).first()[0]


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """``sum(c)`` from the start of each key's rows, in ``order``, to the current row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.sum(c).over(window).alias(n) for n, c in sums.items()])

    heavy = heavy_keys(df, keys)
    if heavy is None:
        return plain(df)
    ordinary, large = split_heavy(df, keys, heavy)
    sliced = slice_ordered(large, keys, order, heavy_rows(heavy))
    return plain(ordinary).unionByName(drop_slices(running_over_slices(sliced, keys, order, sums)))


def running_lasts(df: DataFrame, keys: list[str], order: list[str], lasts: Mapping[str, Column]) -> DataFrame:
    """The last non-null value from the start of each key's rows, in ``order``, to the current row; null before the first."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns({n: F.last(c, ignorenulls=True).over(window) for n, c in lasts.items()})

    heavy = heavy_keys(df, keys)
    if heavy is None:
        return plain(df)
    ordinary, large = split_heavy(df, keys, heavy)
    sliced = slice_ordered(large, keys, order, heavy_rows(heavy))
    return plain(ordinary).unionByName(drop_slices(running_over_slices(sliced, keys, order, lasts=lasts)))


def sequence_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` over (keys, order) as a bigint."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})
