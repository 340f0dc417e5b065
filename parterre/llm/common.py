"""Column helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parterre.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def travels(*names: str) -> None:
    """Send the named modules' functions along with the tasks, so that executors need no installed package."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: later uses don't compute it again, and its size is known."""
    return materialize(df, f"llm-{name}")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where lambdas of ``use`` refer to it for each element."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. ``lower`` is the fast way for texts without other letters."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def matches(text: Column, pattern: str) -> Column:
    """All matches, left to right; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fold_remainder(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3; fold 1 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def row_key(docs: DataFrame) -> Column:
    """A key by which parts of a row find each other again; rows with equal id and text share it."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("#")), docs["text"])


def bitmap_of(bits: DataFrame, size: int) -> np.ndarray:
    """A bit for each value of column ``bit`` (0 to ``size`` - 1) that occurs, low bits first: ``size`` / 8 bytes, however many rows."""
    at = F.col("bit") + 1
    rows = bits.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(row["bits"], np.uint8)
        begin = (row["k"] - 1) * len(part)
        out[begin: begin + len(part)] |= part[: len(out) - begin]
    return out


def in_bitmap(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
