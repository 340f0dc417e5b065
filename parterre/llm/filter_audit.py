"""Interaction of filters: what each takes away in every order, with and without the others.

One pass over the bytes of a text drives a table: the state (outside or inside a
word) and the class of the next byte give the next state and what is counted:
word begins, capitals, code points, symbols. The spans of words go into a hash
table whose hits are verified byte by byte, so that the number of distinct words
is exact. A text's failures of filters A to D become a bit mask; whether it
copies a smaller id's text (E) is decided table-wide by digest. From there on
only counts per part and mask travel, and all 120 orders follow from the 32
masks of a part.

Null texts are empty. A null source is an empty string, and shares the part of
empty ones. Rows that repeat an id and text are copies of neither each other nor
themselves, but all count; rows that repeat an id with other texts are judged one
by one. A null id is not larger than any other, so it passes E, and has no label.
Labels that repeat an id count if any of them says 1. A text is held whole in
one task, with some ten bytes a byte. Only the columns named below are read, so
further ones of any name do no harm. Empty tables give no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import store, travels
from parterre.llm.text import codes, gather, grouped, mixed, span_hashes

travels(__name__, "parterre.llm.common", "parterre.llm.text")

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)

# Classes of bytes, states, and what a step of the machine puts out.
WHITE, CAPITAL, SYMBOL, LEAD, FOLLOW = range(5)
OUTSIDE, INSIDE = 0, 1
WORD_BEGINS, WORD_ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16


def _byte_classes() -> np.ndarray:
    out = np.full(256, LEAD, np.uint8)
    out[0x80:0xC0] = FOLLOW  # continues a code point
    out[[0x20, *range(0x09, 0x0E)]] = WHITE
    out[ord("A"): ord("Z") + 1] = CAPITAL
    out[[ord(c) for c in "#$%&*|"]] = SYMBOL
    return out


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) for each state and byte class."""
    state, output = np.zeros((2, 5), np.uint8), np.zeros((2, 5), np.uint8)
    for before in (OUTSIDE, INSIDE):
        for kind in range(5):
            after = OUTSIDE if kind == WHITE else INSIDE
            state[before, kind] = after
            output[before, kind] = (
                WORD_BEGINS * (after > before) + WORD_ENDS * (after < before) + IS_CAPITAL * (kind == CAPITAL)
                + IS_POINT * (kind != FOLLOW) + IS_SYMBOL * (kind == SYMBOL))
    return state, output


CLASS, (NEXT, OUTPUT) = _byte_classes(), _steps()
_CODES = codes(256, seed=11)


def transduce(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Word spans and counts of every text of a group, in one pass over its bytes.

    The state after a byte depends on that byte's class alone, so the states of
    all bytes are looked up together; each text begins outside of words.
    """
    n = len(offsets) - 1
    kinds = CLASS[data]
    after = NEXT[OUTSIDE][kinds]
    before = np.concatenate(([OUTSIDE], after[:-1])).astype(np.uint8)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = OUTSIDE
    output = OUTPUT.ravel()[before * np.uint8(5) + kinds]
    starts = np.flatnonzero(output & WORD_BEGINS)
    row = np.searchsorted(offsets, starts, "right") - 1
    # A word ends at the white byte after it, or with its text.
    ends = np.flatnonzero(output & WORD_ENDS)
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends = np.sort(np.concatenate((ends, last[after[last] == INSIDE] + 1)))
    count = lambda bit: np.diff(np.concatenate(([0], np.cumsum((output & bit) > 0)))[offsets])
    return {"starts": starts, "stops": ends, "row": row, "words": np.bincount(row, minlength=n),
            "capitals": count(IS_CAPITAL), "points": count(IS_POINT), "symbols": count(IS_SYMBOL)}


def distinct_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, n: int, hashed=None) -> np.ndarray:
    """How many different spans each of ``n`` texts has.

    All spans enter an open table together, keyed by text and bytes. One that finds its slot free takes it; one that
    finds an equal span there (same text, same bytes) is a repetition; the others go on to the next slot.
    """
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    hashed = span_hashes(_CODES[data], starts, stops) if hashed is None else hashed
    slot = (mixed(hashed ^ mixed(row.astype(np.uint64) + np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)
    owner = np.full(size, -1, np.int64)
    found = np.zeros(n, np.int64)
    open_ = np.arange(len(starts))
    while len(open_):
        at = slot[open_]
        claim = open_[owner[at] < 0]
        owner[slot[claim][::-1]] = claim[::-1]  # of several the first
        held = owner[at]
        found += np.bincount(row[open_[held == open_]], minlength=n)
        rest = held != open_
        open_, held = open_[rest], held[rest]
        same = (row[open_] == row[held]) & (hashed[open_] == hashed[held]) & (stops[open_] - starts[open_] == stops[held] - starts[held])
        maybe = np.flatnonzero(same)
        sizes = stops[open_[maybe]] - starts[open_[maybe]]
        if len(maybe):  # spans hold a byte at least
            unequal = gather(data, starts[open_[maybe]], sizes) != gather(data, starts[held[maybe]], sizes)
            same[maybe] = np.add.reduceat(unequal, np.cumsum(sizes) - sizes, dtype=np.int64) == 0
        open_ = open_[~same]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return found


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mask of filters A to D that each text fails."""
    seen = transduce(data, offsets)
    words = seen["words"]
    distinct = distinct_spans(data, seen["starts"], seen["stops"], seen["row"], len(words))
    fails = [words < 50, 100 * distinct < 65 * words, 100 * seen["capitals"] > 5 * seen["points"], seen["symbols"] > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in grouped(batch.column(2)):
            rows = batch.slice(at, len(offsets) - 1)
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(failures(data, offsets), pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "mask", "digest"])


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest of the text) of each document."""
    part = F.coalesce(F.col("source"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long"), part, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _judged, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    kinds = ["part", "mask", "good", "toxic"]
    rows = masked(docs).join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # equal rows become one before anything else is dealt out by id or text
    rows = store(rows.groupBy("doc_id", "digest", *kinds).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    originals = rows.join(first, ["digest", "doc_id"], "left_semi").unionByName(rows.where(F.col("doc_id").isNull()))
    passed = originals.groupBy(*kinds).agg(F.sum("n").alias("passed"))
    every = rows.groupBy(*kinds).agg(F.sum("n").alias("n"))
    both = every.withColumn("passed", F.lit(0).cast("long")).unionByName(passed.withColumn("n", F.lit(0).cast("long")).select(*kinds, "n", "passed"))
    both = both.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    copies = F.lit(1 << FILTERS.index("E"))
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("n")),
                    F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    split = both.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "good", "toxic", "s.*")
    total = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), total(F.col("good"), "good"), total(F.col("toxic"), "toxic"))


def _passing(value: str) -> Column:
    """For each set of filters, the sum over documents that fail none of it."""
    return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(chosen) == 0, F.col(value)).otherwise(0)) for chosen in range(MASKS)])


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    ``shapley`` sums a filter's removals over all orders: of the 120 orders, a filter comes first among the k filters that
    a document fails in 120 / k.
    """
    alone = lambda k: F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0))
    shares = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n") * (120 / F.bit_count("mask")).cast("long")).otherwise(0))
    per_filter = range(len(FILTERS))
    parts = mask_counts(docs, labels).groupBy("part").agg(
        _passing("n").alias("n"), _passing("good").alias("good"), _passing("toxic").alias("toxic"),
        F.array(*map(alone, per_filter)).alias("alone"), F.array(*map(shares, per_filter)).alias("shares"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    chosen = lambda upto: F.aggregate(
        F.slice(F.split("filter_order", ""), 1, upto), F.lit(0), lambda bits, letter: bits.bitwiseOR(bit(letter)))
    letter = F.expr("substring(filter_order, step, 1)")
    rows = rows.withColumns({"f": F.ascii(letter) - ord("A"), "alone_bit": bit(letter),
                             "before": chosen(F.col("step") - 1), "after": chosen(F.col("step"))})
    at = lambda name, index: F.get(name, index)
    lost = lambda name: at(name, F.col("before")) - at(name, F.col("after"))
    failing = at("n", F.lit(0)) - at("n", F.col("alone_bit"))
    return rows.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"), at("alone", F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shares", F.col("f")).alias("shapley"))
