"""Whole-batch text helpers for Arrow tasks: pieces of many texts found and hashed at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about this many bytes, which bounds a task's memory; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash's base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()  # travels to tasks empty

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))


_powers = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:stop]`` for each span, whatever its place; ``values`` are random 64-bit codes."""
    _powers.reach(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers.up[: len(values)], out=sums[1:])
    found = (sums[stops] - sums[starts]) * _powers.down[starts]
    return mixed(found + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def codes(n: int, seed: int = 1) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit codes."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def grouped(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of texts of about ``most`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, raw[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at]
        at = stop


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs without white space; no run crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` of all spans, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_ASCII_LOWER = np.arange(256)
_ASCII_LOWER[65:91] += 32
LOWER_CODES = codes(256, seed=3)[_ASCII_LOWER]


def letter_runs(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, row of the text) of runs of letters (all that is beyond ASCII counts as one), long ones in parts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    parts = -(-(stops - starts) // longest)
    if len(parts) and parts.max() > 1:
        starts = np.repeat(starts, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stops = np.minimum(starts + longest, np.repeat(stops, parts))
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


class WordMemo:
    """Values of words, computed once for each distinct word: ``compute`` takes the words' bytes, A-Z lower-cased."""

    def __init__(self, compute, width: int, most: int = 2_000_000) -> None:
        self.compute, self.width, self.most = compute, width, most
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        unique, one, back = np.unique(span_hashes(LOWER_CODES[data], starts, stops), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.most:
            self.known, self.values = self.known[:0], self.values[:0]
        at = np.searchsorted(self.known, unique)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == unique[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            raw = data.tobytes()
            fresh = [raw[a:b].lower() for a, b in zip(starts[one[new]].tolist(), stops[one[new]].tolist())]
            every = np.concatenate((self.known, unique[new]))
            order = np.argsort(every, kind="stable")
            self.known, self.values = every[order], np.concatenate((self.values, self.compute(fresh)))[order]
            at = np.searchsorted(self.known, unique)
        return self.values[at][back]
