"""Latest-value tables and keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the one that is last in ``order``.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key with very many versions costs no more than any other.
    Comparing whole rows makes it a sorted aggregate on both sides.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*df.columns)


def find_by(df: DataFrame, **equals: object) -> DataFrame:
    """Rows whose named columns have the given values; pushed to the scan."""
    for column, value in equals.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def find_in(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns occur in ``wanted``."""
    return df.join(wanted.select(*on).distinct(), on, "left_semi")


def lookup(requests: DataFrame, table: DataFrame, key: str, request_key: str) -> DataFrame:
    """Every request with the row of ``table`` it names; nulls and ``found = false`` where none does.

    ``key`` is unique in ``table``. Which side is broadcast is left to
    Catalyst's size check; a skewed request key is split by adaptive execution.
    """
    hit = table.withColumn("found", F.lit(True))
    joined = requests.join(hit, requests[request_key] == hit[key], "left")
    return joined.drop(hit[key]).withColumn("found", F.coalesce("found", F.lit(False)))


def exists_flag(df: DataFrame, other: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """``df`` with a boolean: does ``other`` hold a row with equal keys?"""
    marks = other.select(*[F.col(o).alias(f"match_{o}") for o in on.values()]).distinct()
    marks = marks.withColumn("matched", F.lit(True))
    condition: Column = F.lit(True)
    for mine, theirs in on.items():
        condition = condition & (df[mine] == marks[f"match_{theirs}"])
    joined = df.join(marks, condition, "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("matched", F.lit(False)).alias(name))
