"""Alignment of two tokenizers over the same bytes, and which of their ids go together.

Both tokenizers read ``" " + text``. Where a token of either ends, the bytes are
cut into groups; tokens of one group whose bytes overlap are linked. Counts of
linked id pairs over all documents tell which link is a token's usual one.

**Stretches.** Before a single blank with a character on either side, both
tokenizers begin a token. What lies between two such places is a stretch; it is
encoded by the libraries once in a task, however often it occurs.

**Fragments.** A long text is cut into byte ranges that go to different tasks. A
range owns the tokens that end in it, and yields a fragment: the tokens before
the first common end (open prefix), the closed groups, and the tokens after the
last (open suffix). Joining neighbours closes the group between them, and which
neighbours are joined first makes no difference, so the fragments of a document
are reduced level by level, some to a task, by as many tasks as there are.

**Counts.** Some MB of documents make a bundle, which knows its distinct
stretches and pairs. Pairs are counted over all bundles, and the counts of a
bundle's own pairs come back to it; no task sees all pairs or all documents.

Null and empty texts have no tokens, nor have texts whose tokens' bytes are not
those of the text; their row holds zeros and an empty hash. Each row is aligned by itself, also where rows repeat or
the id is null. One stretch is encoded in one task, however long. Only id and text
are read; further columns of any name do no harm. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import store, travels
from parterre.llm.text import codes, gather, grouped, sliced, span_hashes
from parterre.llm.tokens import Encoder, byte_tokens, vocabulary

travels(__name__, "parterre.llm.common", "parterre.llm.text", "parterre.llm.tokens")

#: Texts beyond this are cut into ranges of this many bytes.
RANGE_BYTES = 1 << 16
#: Ranges end near stretches' ends; a stretch longer than this is not cut at all.
CONTEXT_BYTES = 1 << 13
#: Text of a bundle, about.
BUNDLE_BYTES = 1 << 20
#: Fragments joined by one task at a time.
FAN_IN = 16
#: Stretches kept with their groups; beyond, the store starts anew.
MOST_STRETCHES = 120_000

_CODES = codes(256, seed=17)
_NO_IDS = np.zeros(0, np.int64)


def stretch_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the stretches of the texts begin: at texts' starts, and at blanks between two characters.

    A text is meant with its leading blank. The character after the blank is printable ASCII or begins with a byte that
    no white space beyond ASCII begins with; the one before is any but a blank, as both tokenizers keep blanks with what follows.
    """
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    if len(data) > 2:
        after = data[2:]
        solid = ((after > 0x20) & (after < 0x7F)) | ((after >= 0x80) & ~np.isin(after, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)))
        found = np.flatnonzero((data[1:-1] == 0x20) & (data[:-2] != 0x20) & solid) + 1
        crossing = np.zeros(len(data) + 2, bool)  # the byte before or after belongs to another text
        crossing[offsets] = True
        begin[found[~crossing[found] & ~crossing[found + 1]]] = True
    return np.flatnonzero(begin[:-1])


@dataclass
class Fragment:
    """A byte range of a text, as it takes part in joins.

    ``prefix`` and ``suffix`` are (A tokens, B tokens), each a list of (id, size in bytes); ``closed`` are written groups.
    A range that begins where both tokenizers begin a token has no prefix; one with neither such a begin nor a common end
    has all its tokens in the prefix, and ``closed`` is None.
    """

    prefix: tuple[list, list] = field(default_factory=lambda: ([], []))
    closed: list[str] | None = field(default_factory=list)
    suffix: tuple[list, list] = field(default_factory=lambda: ([], []))
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0

    def join(self, other: Fragment, closing: Callable[[list, list], None] = lambda a, b: None) -> Fragment:
        """This range and the next one; ``closing`` is told the group that only the join completes."""
        n = {c: getattr(self, c) + getattr(other, c) for c in ("n_a", "n_b", "n_groups", "n_links")}
        if self.closed is None:
            both = self.prefix[0] + other.prefix[0], self.prefix[1] + other.prefix[1]
            return Fragment(both, other.closed, other.suffix, **n)
        a, b = self.suffix[0] + other.prefix[0], self.suffix[1] + other.prefix[1]
        if other.closed is None:
            return Fragment(self.prefix, self.closed, (a, b), **n)
        between = []
        if a or b:
            closing(a, b)
            between = [rendered(a, b)]
            n["n_groups"] += 1
            n["n_links"] += len(a) + len(b) - 1
        return Fragment(self.prefix, self.closed + between + other.closed, other.suffix, **n)

    def to_json(self) -> str:
        closed = None if self.closed is None else ";".join(self.closed)
        return json.dumps([self.prefix, closed, self.suffix, self.n_a, self.n_b, self.n_groups, self.n_links])

    @classmethod
    def of_json(cls, text: str) -> Fragment:
        prefix, closed, suffix, *n = json.loads(text)
        return cls(tuple(prefix), closed if closed is None else [closed] if closed else [], tuple(suffix), *n)


def rendered(a: list, b: list) -> str:
    return ",".join(str(k) for k, _ in a) + "|" + ",".join(str(k) for k, _ in b)


def links(a: list, b: list) -> list[int]:
    """The overlapping pairs of a group of (id, size) tokens, as numbers (A id << 32 | B id)."""
    return closed_groups([k for k, _ in a], [k for k, _ in b], [n for _, n in a], [n for _, n in b])[2]


def closed_groups(a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int]) -> tuple[str, int, list[int]]:
    """(written groups, their number, links) of tokens of either side that cover the same bytes."""
    written, found = [], []
    i = j = from_a = from_b = 0
    end_a, end_b = sizes_a[0], sizes_b[0]
    while True:
        found.append(a[i] << 32 | b[j])
        if end_a < end_b:
            i += 1
            end_a += sizes_a[i]
        elif end_b < end_a:
            j += 1
            end_b += sizes_b[j]
        else:
            i, j = i + 1, j + 1
            written.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
            if i == len(a):
                return ";".join(written), len(written), found
            from_a, from_b = i, j
            end_a, end_b = end_a + sizes_a[i], end_b + sizes_b[j]


class Tokenizers:
    """Both libraries, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.library.encode_special_tokens = True
        with open(path_a) as f:
            self.bytes_a = byte_tokens(json.load(f))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.vocabularies = vocabulary(self.bytes_a), vocabulary(self.bytes_b)

    def _piece(self, k: int) -> bytes:
        shown = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(shown[3:5], 16)])
        return shown.replace("▁", " ").encode()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(all ids, how many each) by A and by B, of texts that begin with the blank which B adds itself."""
        a, counts = self.a.encode_group(data, offsets)
        raw, ends = data.tobytes(), offsets.tolist()
        lists = self.b.encode([raw[x + 1: y].decode() for x, y in zip(ends, ends[1:])], num_threads=1)
        return [(a.astype(np.int64), counts), (np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))]

    def encode(self, text: str) -> tuple[list, list] | None:
        """Tokens of A and B as (id, size in bytes); None where their bytes are not those of the text."""
        raw = text.encode()
        (a, _), (b, _) = self.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        a, b = a.tolist(), b.tolist()
        if any(b"".join(known[k] for k in ids) != raw for ids, known in ((a, self.bytes_a), (b, self.bytes_b))):
            return None
        return [(k, len(self.bytes_a[k])) for k in a], [(k, len(self.bytes_b[k])) for k in b]


def fragment_of(a: list, b: list, low: int = 0, high: int | None = None, closing: Callable[[list, list], None] = lambda a, b: None) -> Fragment:
    """The fragment of the (id, size) tokens that end in (``low``, ``high``], of tokens that begin together at 0."""
    ends = [np.cumsum([size for _, size in side], dtype=np.int64) for side in (a, b)]
    first = [int(np.searchsorted(e, low, "right")) for e in ends]
    stop = [len(e) if high is None else int(np.searchsorted(e, high, "right")) for e in ends]
    both = np.intersect1d(ends[0][first[0]: stop[0]], ends[1][first[1]: stop[1]], assume_unique=True)
    cuts = list(zip((np.searchsorted(ends[0], both) + 1).tolist(), (np.searchsorted(ends[1], both) + 1).tolist()))
    n = {"n_a": stop[0] - first[0], "n_b": stop[1] - first[1]}
    prefix, closed, n_links = ([], []), [], 0
    if low > 0:
        cut = cuts.pop(0) if cuts else stop
        prefix = a[first[0]: cut[0]], b[first[1]: cut[1]]
        if cut is stop:
            return Fragment(prefix, None, **n)
        first = cut
    for cut in cuts:
        group = a[first[0]: cut[0]], b[first[1]: cut[1]]
        closing(*group)
        closed.append(rendered(*group))
        n_links += len(group[0]) + len(group[1]) - 1
        first = cut
    return Fragment(prefix, closed, (a[first[0]: stop[0]], b[first[1]: stop[1]]), **n, n_groups=len(closed), n_links=n_links)


class Growing:
    """Arrays one after the other in one buffer."""

    def __init__(self, kind: type, width: int | None = None) -> None:
        self._buffer, self.size = np.zeros((64, width) if width else 64, kind), 0

    def append(self, values: np.ndarray) -> None:
        stop = self.size + len(values)
        if stop > len(self._buffer):
            grown = np.zeros((2 * stop, *self._buffer.shape[1:]), self._buffer.dtype)
            grown[: self.size] = self._buffer[: self.size]
            self._buffer = grown
        self._buffer[self.size: stop] = values
        self.size = stop

    def values(self) -> np.ndarray:
        return self._buffer[: self.size]


#: What follows a written id: another of its side, the other side, the next group.
_AFTER = ",|;"


class Stretches:
    """The groups and links of stretches met so far, by number; also single groups that are linked elsewhere."""

    def __init__(self, tokenizers: Tokenizers | None = None) -> None:
        self.tokenizers = tokenizers
        if tokenizers is not None:
            most = max(len(tokenizers.bytes_a), len(tokenizers.bytes_b))
            self._texts, self._text_at = vocabulary([f"{k}{c}".encode() for k in range(most) for c in _AFTER])
        self.forget()

    def forget(self) -> None:
        self._known, self._number = np.zeros(0, np.uint64), _NO_IDS
        self._items, self._links = Growing(np.int32), Growing(np.int64)
        # per number: tokens of A and B, groups, links, 1 for what has no tokens, where its items and its links begin
        self._about = Growing(np.int64, 7)

    def __len__(self) -> int:
        return self._about.size

    def add(self, links_: list[int]) -> int:
        """A number for the links of a single group; its tokens are counted elsewhere."""
        self._about.append(np.array([[0, 0, 0, len(links_), 0, self._items.size, self._links.size]]))
        self._links.append(np.array(links_, np.int64))
        return len(self) - 1

    def numbers(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each stretch; new ones are encoded."""
        unique, one, back = np.unique(span_hashes(_CODES[data], starts, stops), return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, unique)
        seen = at < len(self._known)
        seen[seen] = self._known[at[seen]] == unique[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            numbers = len(self) + np.arange(len(new))
            self._encode(data, starts[one[new]], stops[one[new]])
            every = np.concatenate((self._known, unique[new]))
            order = np.argsort(every, kind="stable")
            self._known, self._number = every[order], np.concatenate((self._number, numbers))[order]
            at = np.searchsorted(self._known, unique)
        return self._number[at][back]

    def _encode(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Add the stretches, all at once: as if they were one text, whose tokens end together at each stretch's end."""
        sizes = stops - starts
        ids, counts = zip(*self.tokenizers.ids(gather(data, starts, sizes), np.append(0, np.cumsum(sizes))))
        token_sizes = [offsets[i + 1] - offsets[i] for i, (_, offsets) in zip(ids, self.tokenizers.vocabularies)]
        good = np.ones(len(starts), bool)
        for side in (0, 1):
            good &= _sums(token_sizes[side], counts[side]) == sizes
        row = np.repeat(np.arange(len(starts)), np.where(good, sizes, 0))
        want = gather(data, starts[good], sizes[good])
        for side, (known, offsets) in enumerate(self.tokenizers.vocabularies):
            kept = np.repeat(good, counts[side])
            other = gather(known, offsets[ids[side][kept]], token_sizes[side][kept]) != want
            if other.any():
                wrong = np.unique(row[other])
                good[wrong] = False
                return self._encode_rest(data, starts, stops, good)
        self._add(good, sizes, ids, counts, token_sizes)

    def _encode_rest(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, good: np.ndarray) -> None:
        """The stretches one by one, where the bytes of some differ though they are as many."""
        for k, (x, y) in enumerate(zip(starts.tolist(), stops.tolist())):
            if good[k]:
                self._encode(data, starts[k: k + 1], stops[k: k + 1])
            else:
                self._about.append(np.array([[0, 0, 0, 0, 1, self._items.size, self._links.size]]))

    def _add(self, good: np.ndarray, sizes: np.ndarray, ids: list, counts: list, token_sizes: list) -> None:
        kept = [np.repeat(good, n) for n in counts]
        a, b = (i[k] for i, k in zip(ids, kept))
        n_a, n_b = (np.where(good, n, 0) for n in counts)
        end_a, end_b = (np.cumsum(t[k]) for t, k in zip(token_sizes, kept))
        last_a, last_b = _meet(end_a, end_b), _meet(end_b, end_a)  # the last tokens of groups
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many_a, many_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
        items = np.empty(len(a) + len(b), np.int32)
        items[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a * len(_AFTER) + last_a
        items[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b * len(_AFTER) + 2 * last_b
        # each overlapping pair shares one stretch of bytes between ends of either side
        ends = np.union1d(end_a, end_b)
        pairs = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        n_links = np.diff(np.searchsorted(ends, np.cumsum(np.where(good, sizes, 0)), "right"), prepend=0)
        begins = lambda n, at: at + np.cumsum(n) - n
        self._about.append(np.stack((
            n_a, n_b, _sums(last_a.astype(np.int64), n_a), n_links, ~good, begins(n_a + n_b, self._items.size), begins(n_links, self._links.size)), axis=1))
        self._items.append(items)
        self._links.append(pairs)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """For each number: tokens of A and B, groups, links, and 1 for what has no tokens."""
        return self._about.values()[numbers, :5]

    def written(self, numbers: np.ndarray, parts: np.ndarray) -> Iterator[memoryview]:
        """The groups of each part (so many numbers), as they are hashed."""
        about = self._about.values()[numbers]
        n = about[:, 0] + about[:, 1]
        items = gather(self._items.values(), about[:, 5], n)
        sizes = self._text_at[items + 1] - self._text_at[items]
        shown = memoryview(gather(self._texts, self._text_at[items], sizes))
        ends = np.cumsum(_sums(_sums(sizes, n), parts))
        for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            yield shown[begin: max(begin, end - 1)]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of all the numbers one after the other, how many each has)."""
        about = self._about.values()[numbers]
        return gather(self._links.values(), about[:, 6], about[:, 3]), about[:, 3]


def _meet(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the ends are among the others'."""
    return others[np.minimum(np.searchsorted(others, ends), len(others) - 1)] == ends if len(others) else np.zeros(len(ends), bool)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of so many values."""
    through = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return through[ends] - through[ends - sizes]


BUNDLE = ("bundle long, key long, doc_ids array<long>, parts array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, results array<string>, pairs array<long>, times array<long>, width int, codes binary, code_counts binary, "
          "entry_links binary, entry_sizes binary")
_BUNDLE_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_BUNDLE_SCHEMA = pa.schema([(n, _BUNDLE_KINDS[t]) for n, t in (c.split() for c in BUNDLE.split(", "))])


class Bundles:
    """Gathers rows (an id, counts, a result, the numbers of its stretches) into bundles."""

    def __init__(self, stretches: Stretches, pass_: int) -> None:
        self.stretches, self.pass_, self.made = stretches, pass_, 0
        self.rows: list[tuple] = []
        self.numbers: list[np.ndarray] = []

    def add(self, doc_id: int | None, part: int, counts: Iterable[int], result: str, numbers: np.ndarray) -> None:
        self.rows.append((doc_id, part, *counts, result))
        self.numbers.append(numbers)

    def flush(self, key: int | None = None) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        every = np.concatenate(self.numbers)
        used, codes_, times = np.unique(every, return_inverse=True, return_counts=True)
        found, sizes = self.stretches.links_of(used)
        pairs, at = np.unique(found, return_inverse=True)
        width = 2 if len(used) < 1 << 16 else 4
        doc_ids, parts, n_a, n_b, n_groups, n_links, results = map(list, zip(*self.rows))
        yield pa.RecordBatch.from_pylist([{
            "bundle": (self.pass_ << 56) + (TaskContext.get().partitionId() << 28) + self.made, "key": key, "doc_ids": doc_ids, "parts": parts,
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "results": results, "pairs": pairs,
            "times": np.bincount(at, np.repeat(times, sizes), len(pairs)).astype(np.int64), "width": width,
            "codes": codes_.astype(f"<u{width}").tobytes(), "code_counts": np.array([len(n) for n in self.numbers], "<u4").tobytes(),
            "entry_links": at.astype("<u4").tobytes(), "entry_sizes": sizes.astype("<u4").tobytes()}], _BUNDLE_SCHEMA)
        self.made += 1
        self.rows, self.numbers = [], []
        if len(self.stretches) > MOST_STRETCHES:
            self.stretches.forget()


def _digest(written: bytes | memoryview) -> str:
    return hashlib.sha256(written).hexdigest() if len(written) else ""


def _short_documents(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = Stretches(Tokenizers(path_a, path_b))
        bundles, held = Bundles(stretches, 0), 0
        for batch in sliced(batches):
            doc_ids = batch.column(0).to_pylist()
            for at, data, offsets in grouped(batch.column(1), BUNDLE_BYTES // 4):
                starts = stretch_starts(data, offsets)
                numbers = stretches.numbers(data, starts, np.append(starts[1:], len(data)))
                counts = stretches.counts(numbers)
                parts = np.diff(np.searchsorted(starts, offsets))
                valid = _sums(counts[:, 4], parts) == 0
                numbers, parts = numbers[np.repeat(valid, parts)], np.where(valid, parts, 0)
                sums = np.stack([_sums(counts[np.repeat(valid, np.diff(np.searchsorted(starts, offsets))), c], parts) for c in range(4)], axis=1).tolist()
                ends = np.cumsum(parts).tolist()
                for k, (written, end, n) in enumerate(zip(stretches.written(numbers, parts), ends, parts.tolist())):
                    bundles.add(doc_ids[at + k], 0, sums[k], _digest(written), numbers[end - n: end])
                held += len(data)
                if held >= BUNDLE_BYTES:
                    yield from bundles.flush()
                    held = 0
        yield from bundles.flush()

    return run


def _ranges(range_bytes: int, context: int) -> Callable:
    """Long texts into ranges: the text from the stretch where the range begins to the end of the one where it ends."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, 1):
            for at, data, offsets in grouped(batch.column(1)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = data[a:b]
                    starts = stretch_starts(text, np.array([0, len(text)]))
                    stops = np.append(starts[1:], len(text))
                    edges = np.arange(range_bytes, len(text), range_bytes)
                    k = np.searchsorted(starts, edges, "right") - 1
                    near = stops[k] - starts[k] <= context
                    edges, k = edges[near], k[near]
                    lows, highs = np.append(0, edges), np.append(edges, len(text))
                    first = np.append(0, starts[k])
                    last = np.append(np.where(edges == starts[k], edges, stops[k]), len(text))
                    raw = text.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(lows), pa.int64()), pa.array([batch.column(0)[0].as_py()] * len(lows), pa.int64()),
                         pa.array(np.arange(len(lows))), pa.array(lows - first), pa.array(highs - first),
                         pa.array([raw[x:y] for x, y in zip(first.tolist(), last.tolist())], pa.binary()).cast(pa.string())],
                        ["key", "doc_id", "part", "low", "high", "text"])
                    key += 1

    return run


def range_fragment(stretches: Stretches, text: str, low: int, high: int) -> tuple[Fragment | None, np.ndarray]:
    """The fragment of the tokens of ``text`` that end in (``low``, ``high``], and the numbers of what is linked in it.

    None for a text that has no tokens because their bytes differ.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    starts = stretch_starts(data, np.array([0, len(data)]))
    stops = np.append(starts[1:], len(data))
    numbers = stretches.numbers(data, starts, stops)
    counts = stretches.counts(numbers)
    if counts[:, 4].any():
        return None, _NO_IDS
    whole = (starts >= low) & (stops <= high)
    inside, extra = numbers[whole], []
    close = lambda a, b: extra.append(stretches.add(links(a, b)))
    n = counts[whole].sum(axis=0).tolist()
    (written,) = stretches.written(inside, np.array([len(inside)]))
    parts = [None, Fragment(closed=[written.tobytes().decode()], n_a=n[0], n_b=n[1], n_groups=n[2], n_links=n[3]) if len(inside) else None, None]
    raw = data.tobytes()
    for k in np.flatnonzero(~whole & (stops > low) & (starts < high)).tolist():
        tokens = stretches.tokenizers.encode(raw[starts[k]: stops[k]].decode())
        cut = fragment_of(*tokens, low=max(0, low - int(starts[k])), high=high - int(starts[k]), closing=close)
        parts[0 if starts[k] < low else 2] = cut
    return reduce(lambda x, y: x.join(y, close), [p for p in parts if p is not None]), np.append(inside, extra).astype(np.int64)


def _range_fragments(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = Stretches(Tokenizers(path_a, path_b))
        bundles = Bundles(stretches, 1)
        for batch in sliced(batches, 16):
            for row in batch.to_pylist():
                found, numbers = range_fragment(stretches, row["text"], row["low"], row["high"])
                bundles.add(row["doc_id"], row["part"], (0, 0, 0, 0), "" if found is None else found.to_json(), numbers)
                yield from bundles.flush(row["key"])

    return run


def _joined(pass_: int) -> Callable:
    """Fragments of a document, in order, to one for each run of ``FAN_IN``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = Stretches()
        bundles = Bundles(stretches, pass_)
        extra: list[int] = []
        close = lambda a, b: extra.append(stretches.add(links(a, b)))
        now, held, doc_id = None, [], None

        def finished() -> Iterator[pa.RecordBatch]:
            # the halves of a run are joined first, so that nothing is copied more often than the tree is deep
            level = held
            while len(level) > 1:
                level = [level[k].join(level[k + 1], close) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            bundles.add(doc_id, now[1], (0, 0, 0, 0), level[0].to_json(), np.array(extra, np.int64))
            extra.clear()
            yield from bundles.flush(now[0])
            stretches.forget()

        for batch in sliced(batches, 16):
            for row in batch.to_pylist():
                group = (row["key"], row["part"] // FAN_IN)
                if group != now and held:
                    yield from finished()
                    held = []
                now, doc_id = group, row["doc_id"]
                held.append(Fragment.of_json(row["fragment"]))
        if held:
            yield from finished()

    return run


_RESULT = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_RESULT_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _RESULT.split(", "))])


def _whole_results(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        f = Fragment.of_json(batch.column("fragment")[0].as_py())
        yield pa.RecordBatch.from_pylist([{
            "key": batch.column("key")[0].as_py(), "doc_id": batch.column("doc_id")[0].as_py(), "n_a": f.n_a, "n_b": f.n_b,
            "n_groups": f.n_groups, "n_links": f.n_links, "groups_sha256": _digest(";".join(f.closed).encode())}], _RESULT_SCHEMA)


def _fragments(bundles: DataFrame) -> DataFrame:
    rows = F.explode(F.arrays_zip("doc_ids", "parts", "results")).alias("r")
    return bundles.select("key", rows).select("key", F.col("r.doc_ids").alias("doc_id"), F.col("r.parts").alias("part"), F.col("r.results").alias("fragment"))


def _long_documents(docs: DataFrame, path_a: str, path_b: str, range_bytes: int, context: int) -> tuple[DataFrame, DataFrame]:
    """(bundles of their links, one row each with its counts and hash)."""
    ranges = store(docs.mapInArrow(_ranges(range_bytes, context), "key long, doc_id long, part long, low long, high long, text string"), "align-ranges")
    spread = ranges.repartition(F.xxhash64("key", "part"))
    made = store(spread.mapInArrow(_range_fragments(path_a, path_b), BUNDLE), "align-fragments")
    every = _fragments(made)
    wrong = store(every.where(F.col("fragment") == "").select("key", "doc_id").distinct(), "align-wrong")
    bundles = [made.join(wrong, "key", "left_anti")]
    left = every.join(wrong, "key", "left_anti")
    last = left.agg(F.max("part")).first()[0] or 0
    pass_ = 2
    while last > 0:
        task = F.xxhash64("key", F.floor(F.col("part") / FAN_IN))
        made = store(left.repartition(task).sortWithinPartitions("key", "part").mapInArrow(_joined(pass_), BUNDLE), "align-fragments")
        bundles.append(made)
        left, last, pass_ = _fragments(made), last // FAN_IN, pass_ + 1
    right = left.mapInArrow(_whole_results, _RESULT)
    zeros = {c: F.lit(0).cast("long") for c in ("n_a", "n_b", "n_groups", "n_links")}
    return reduce(DataFrame.unionByName, bundles), right.unionByName(wrong.withColumns(zeros | {"groups_sha256": F.lit("")}))


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a bundle with the sums over its links."""
    for batch in sliced(batches, 1):
        row = {c: batch.column(c)[0] for c in batch.schema.names}
        values = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        size = row["n_pairs"].as_py()
        totals, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if row["found"].is_valid and size:
            found = row["found"].values
            at = found.field("at").to_numpy(zero_copy_only=False)
            totals[at] = found.field("total").to_numpy(zero_copy_only=False)
            best[at] = found.field("best").to_numpy(zero_copy_only=False)
        raw = lambda name, kind: np.frombuffer(row[name].as_py(), kind).astype(np.int64)
        entry_links, entry_sizes = raw("entry_links", "<u4"), raw("entry_sizes", "<u4")
        codes_, code_counts = raw("codes", f"<u{row['width'].as_py()}"), raw("code_counts", "<u4")
        sums = []
        for of_pair in (best, totals):
            of_entry = _sums(of_pair[entry_links], entry_sizes)
            sums.append(_sums(of_entry[codes_], code_counts))
        n = len(code_counts)
        arrays = [pa.array([row["key"].as_py()] * n, pa.int64()), row["doc_ids"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")],
                  row["results"].values, pa.array(sums[0]), pa.array(sums[1])]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])


def pair_counts(bundles: DataFrame) -> DataFrame:
    """(pair, a, b, total, best): links of each id pair in all documents, and whether no pair with its B id has more."""
    links_ = bundles.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("l.pairs", "l.times")
    totals = store(links_.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total")), "align-pairs").withColumns(
        {"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, range_bytes: int = RANGE_BYTES, context: int = CONTEXT_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text)."""
    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).otherwise(F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    is_long = F.octet_length("text") > range_bytes
    short = store(rows.where(~is_long).mapInArrow(_short_documents(path_a, path_b), BUNDLE), "align-bundles")
    long_bundles, long_rows = _long_documents(rows.where(is_long), path_a, path_b, range_bytes, context)
    bundles = short.unionByName(long_bundles)
    counts = pair_counts(bundles).select("pair", "total", F.col("best").cast("int").alias("best"))
    asked = bundles.select("bundle", F.posexplode("pairs").alias("at", "pair"))
    back = asked.join(counts, "pair").groupBy("bundle").agg(F.collect_list(F.struct("at", "total", "best")).alias("found"))
    # the pairs themselves stay where they are: a bundle knows them by their places
    scored = bundles.withColumn("n_pairs", F.size("pairs")).drop("times", "parts", "pairs").join(back, "bundle", "left").drop("bundle").mapInArrow(
        _scored, "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    scored = store(scored, "align-scored")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    of_ranges = scored.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole_long = long_rows.join(of_ranges, "key", "left").na.fill(0, ["n_best", "count_sum"])
    return scored.where(F.col("key").isNull()).select(*columns).unionByName(whole_long.select(*columns))
