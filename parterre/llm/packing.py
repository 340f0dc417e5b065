"""Packing of documents into sequences of a fixed length, with as few sequences as can be.

Documents are encoded where they lie and cut into pieces; only pieces' lengths
decide the packing, and there are no more lengths than a sequence has places. So
the plan is made from a count per length, whatever the number of documents: the
longest length there is leaves a gap, and single, pair and triple sums of the
lengths at hand are looked up for one that fills it exactly, as often as there
are pieces. While none does, the longest piece that fits goes in as well. What
can't be completed exactly is packed best fit, the longest first.

A plan is a list of patterns (lengths side by side) with a count each, at most a
few for each length. A piece finds its place by its rank among those of its
length: the rank inside its task, and the number of such pieces in the tasks
before. No task sees all pieces of a length, however common it is.

Null texts are empty; with an end id they are pieces of one id, without one they
have no piece. Rows that repeat an id, and null ids, are packed as documents of
their own. A long text is held whole in one task and cut into as many pieces as
it needs. Only id and text are read; further columns of any name do no harm. An
empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parterre.llm.common import store, travels
from parterre.llm.text import grouped, sliced
from parterre.llm.tokens import Encoder

travels(__name__, "parterre.llm.common", "parterre.llm.text", "parterre.llm.tokens")

PIECES = "shard int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), written: where they begin, lengths, checksums, and the ``rank`` of a piece
    among those of its length in its task (``shard``). Of a longer document, all but the first piece are full."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in sliced(batches):
            for at, data, offsets in grouped(batch.column(1)):
                ids, counts = encoder.encode_group(data, offsets)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                number = -(-counts // size)
                row = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                first = counts - size * (number - 1)
                length = np.where(piece == 0, first[row], size)
                start = np.where(piece == 0, 0, first[row] + size * (piece - 1))
                begin = (np.cumsum(counts) - counts)[row] + start
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * a: 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                one, first_of, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(first_of, many) + np.repeat(seen[one], many)
                seen[one] += many
                columns = [np.full(len(row), shard, np.int32), rank, batch.column(0).slice(at, len(counts)).take(pa.array(row)), piece.astype(np.int32),
                           start, length.astype(np.int32), np.array([zlib.crc32(p) for p in parts], np.int64)]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return store(found.mapInArrow(cut, PIECES + ", ids binary" * with_ids), "pieces")


class Complements:
    """Which available lengths fill a gap exactly, as one, two or three pieces."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def filling(self, gap: int, taken: dict[int, int], most: int) -> list[int] | None:
        """At most ``most`` lengths, longest first, whose sum is ``gap``, with what ``taken`` leaves; None if there are none."""
        left = self.counts[: gap + 1].copy()
        for length, n in taken.items():
            if length <= gap:
                left[length] -= n
        if left[gap] > 0:
            return [gap]
        pair = self._pair(left, gap) if most > 1 else None
        if pair or most < 3:
            return pair
        for x in np.flatnonzero(left[1:] > 0)[::-1].tolist():
            x += 1
            rest = gap - x
            if rest < 2:
                continue
            if 3 * x < gap:
                break  # the longest of three is a third of the gap at least
            left[x] -= 1
            pair = self._pair(left, rest, most=x)
            left[x] += 1
            if pair:
                return [x, *pair]
        return None

    @staticmethod
    def _pair(left: np.ndarray, total: int, most: int | None = None) -> list[int] | None:
        low = (total + 1) // 2
        high = min(total - 1, total if most is None else most)
        if high < low:
            return None
        longer = left[low: high + 1] > 0
        shorter = left[total - high: total - low + 1][::-1] > 0
        both = longer & shorter
        if total % 2 == 0 and both[0]:
            both[0] = left[low] > 1
        at = np.flatnonzero(both)
        return [low + int(at[-1]), total - low - int(at[-1])] if len(at) else None


Plan = list[tuple[tuple[int, ...], int]]


def packing_plan(counts: np.ndarray) -> Plan:
    """(lengths side by side, how many such sequences) for ``counts[n]`` pieces of each length n; the size is len - 1.

    Gaps are filled by single pieces, then by pairs, then by triples, and the residue best fit. Filling more gaps exactly may
    leave a residue that wastes more, so this is done with singles only, with pairs, and with triples; the shortest is kept.
    """
    counts = counts.copy()
    counts[0] = 0
    least = -(-int(counts @ np.arange(len(counts))) // (len(counts) - 1))
    length = lambda plan: sum(times for _, times in plan)
    plans, done = [], []
    for most in (1, 2, 3):
        done += _completed(counts, most, grow=False)
        left = counts.copy()
        grown = _completed(left, most, grow=True)
        plans += [done + _best_fit(counts), done + grown + _best_fit(left)]
        if length(min(plans, key=length)) == least:
            break
    return min(plans, key=length)


def _completed(counts: np.ndarray, most: int, grow: bool) -> Plan:
    """Sequences filled exactly, their longest pieces first; ``counts`` keeps what is left.

    With ``grow``, the longest piece that fits joins the first one while nothing fills the gap.
    """
    size, index, plan = len(counts) - 1, Complements(counts), []
    for longest in np.flatnonzero(counts)[::-1].tolist():
        while counts[longest]:
            pattern = _filled(index, longest, size, most, grow)
            if pattern is None:
                break
            lengths, needed = np.unique(pattern, return_counts=True)
            times = int((counts[lengths] // needed).min())
            counts[lengths] -= times * needed
            plan.append((pattern, times))
    return plan


def _filled(index: Complements, longest: int, size: int, most: int, grow: bool) -> tuple[int, ...] | None:
    pattern, gap = [longest], size - longest
    taken: dict[int, int] = defaultdict(int, {longest: 1})
    while gap:
        exact = index.filling(gap, taken, most)
        if exact:
            return (*pattern, *exact)
        fits = [n for n in np.flatnonzero(index.counts[: gap + 1]).tolist() if index.counts[n] > taken[n]] if grow else []
        if not fits:
            return None
        pattern.append(fits[-1])
        taken[fits[-1]] += 1
        gap -= fits[-1]
    return tuple(pattern)


def _best_fit(counts: np.ndarray) -> Plan:
    """Best fit, longest first, over many equal sequences at a time."""
    size = len(counts) - 1
    open_: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(size + 1)]  # by gap
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        gap = length
        while left and gap <= size:
            if not open_[gap]:
                gap += 1
                continue
            pattern, times = open_[gap].popitem()
            used = min(times, left)
            if times > used:
                open_[gap][pattern] += times - used
            open_[gap - length][(*pattern, length)] += used
            left -= used
            gap -= length if gap >= 2 * length else 0
        each = size // length
        if left // each:
            open_[size - each * length][(length,) * each] += left // each
        if left % each:
            open_[size - left % each * length][(length,) * (left % each)] += 1
    return [item for groups in open_ for item in groups.items()]


class Places:
    """Where the piece of a length and rank goes."""

    def __init__(self, plan: Plan, size: int) -> None:
        ranks = np.zeros(size + 1, np.int64)
        slots, sequence = [], 0
        for pattern, times in plan:
            many: dict[int, list[int]] = defaultdict(list)
            at = 0
            for length in pattern:
                many[length].append(at)
                at += length
            for length, offsets in many.items():
                slots += [(length, ranks[length] + k * times, sequence, offset) for k, offset in enumerate(offsets)]
                ranks[length] += times * len(offsets)
            sequence += times
        self.sequences = sequence
        slots.sort()
        self.length, self.rank, self.sequence, self.offset = np.array(slots, np.int64).reshape(-1, 4).T
        self.begin = np.searchsorted(self.length, np.arange(size + 2))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        order = np.lexsort((rank, length))
        slot = np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = order[np.searchsorted(length[order], n): np.searchsorted(length[order], n, "right")]
            a, b = self.begin[n], self.begin[n + 1]
            slot[mine] = a + np.searchsorted(self.rank[a:b], rank[mine], "right") - 1
        return self.sequence[slot] + rank - self.rank[slot], self.offset[slot]


def pack(cut: DataFrame, size: int) -> DataFrame:
    """``cut`` (of :func:`pieces`) with the sequence and the place in it of each piece."""
    per_shard = store(cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # one row a length at most
    totals = {r["length"]: r["n"] for r in per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(size + 1, np.int64)
    for length, n in totals.items():
        counts[length] = n
    places = Places(packing_plan(counts), size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_shard.select("shard", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if "ids" in cut.columns else [])]
    spread = cut.sparkSession.sparkContext.broadcast(places)  # a few slots for each length

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = spread.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) if c != "length" else batch.column(c).cast(pa.int64()) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(placed, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    return pack(pieces(docs, tokenizer, size, end_id, with_ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids as 4-byte integers, doc_ids) of a packing made with its ids; no sequence outgrows the size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
