"""N-gram Jaccard self-join over a count-vector R-tree.

A document's set is its distinct shingles. Shingles are hashed into ``GROUPS``
groups; how many fall into each makes the document a point. For two sets the
overlap is at most the sum over groups of the smaller count, so a box of points
(its upper corner) bounds the overlap of everything below it: an R-tree over the
points answers which sets can still reach the needed overlap with a given one.

A tree over all points would have to be searched by every document, so the
points are first dealt out: in a common order of shingles, two sets with Jaccard
``t`` share a shingle among the first ``n - ceil(t n) + 1`` of each. Every such
shingle gets the points of its sets, and a tree is bulk-loaded for them (by size,
then by counts). Shingles in unusually many documents come last in the order, so
shared passages don't gather their documents; the counts behind it are over all
documents, in a sketch of fixed size, and any error in them costs time only.

Pairs that survive meet the same bound once more on finer counts (as many
groups as shingles, each empty, with one or with more), and what is left is verified on the full sets. A shingle with up to
``LEAF`` sets gives all its surviving pairs. In a larger one, first each set is
only paired with the first in a fixed order of those near it in the tree. The
order is the same under every shingle, so a group of copies meets at few of its
sets and gives few pairs; then sets of different components, and only those, are
compared in blocks. What comes from a block is not its pairs: first the sets that
both bounds let reach one of another component, then, with these sets in full
beside each other, a forest of the links between components. So
what is made grows with the sets of a group, not with its pairs, and no link is lost that could
join two components. Equal sets are one class throughout.

``components`` returns, for each row, the class's set size and the smallest
doc_id that links lead to. Documents with fewer words than a shingle have one
shingle, the whole; those without words have none and stay alone. Null text has
no words; a null doc_id is passed over in the minimum (null if there is no
other). Rows that repeat an id are documents of their own. Shingles are compared
by 64-bit hashes. A text and its set are held whole in one task. Only id and text are read, so
other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import bitmap_of, in_bitmap, store, travels
from parterre.llm.text import codes, grouped, mixed, span_hashes, words

travels(__name__, "parterre.llm.common", "parterre.llm.text")

WORDS, PERCENT = 5, 80
GROUPS, LEAF, BLOCK = 8, 8, 512
#: Blocks between which components are joined are this much larger: a set is copied once for each block of its shingle.
WIDER = 4
#: Shingles with the same first set are one group up to so many sets; with more sets they are dealt to as many more groups.
GROUP = 64
#: Shingles of the sets that are verified beside each other in one task; more are dealt to parts, each pair to one of them.
TOGETHER = 1 << 23
#: Share of its size by which a set is near another, if the bound allows it.
NEAR = 0.9
#: Buckets of the sketch of document frequencies, and bits of the bitmap of wanted classes: fixed sizes.
SKETCH, BITMAP = 1 << 18, 1 << 22
#: Pairs (or words of their points) that a task compares at once.
PAIRS = 1 << 19

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = codes(256, seed=3)[_LOWER]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, stops = words(data, offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    hashes = span_hashes(_BYTES[data], starts, stops)
    counts = np.bincount(of, minlength=len(offsets) - 1)
    ends = np.cumsum(counts)
    full = len(hashes) - n_words + 1
    joined = np.zeros(max(full, 0), np.uint64)
    place = codes(n_words + 1, seed=17) | np.uint64(1)
    for k in range(n_words if full > 0 else 0):
        joined += hashes[k: k + full] * place[k]
    joined = mixed(joined)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        begin = end - n
        if n >= n_words:
            out.append(np.unique(joined[begin: end - n_words + 1]))
        elif n:  # the number of words keeps a short sequence apart from a shingle
            out.append(mixed(np.atleast_1d((hashes[begin:end] * place[:n]).sum(dtype=np.uint64)) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    a = mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    b = mixed(shingles ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def point(shingles: np.ndarray) -> int:
    """Counts of the groups in a byte each, rounded up to units that let the largest fit."""
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    unit = unit_of(min(len(shingles), _SIZE))  # the size that a posting tells
    return int(np.minimum(-(-counts // unit), 255).astype(np.uint8).view(np.int64)[0])


def fine_point(shingles: np.ndarray) -> bytes:
    """Which of the fine groups hold a shingle, and which hold two: two planes of bits. There are as many groups as
    shingles, up to the next power of two."""
    groups = 1 << max(8, len(shingles).bit_length())
    counts = np.bincount(((shingles >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.packbits(np.concatenate([counts > 0, counts > 1]), bitorder="little").tobytes()


def fine_bound(x: bytes, y: bytes, m: int, n: int) -> int:
    """The most that sets of ``m`` and ``n`` can share by their fine points."""
    table = FineCounts([x, y], np.array([m, n]))
    return int(table.bounds(np.array([0]), np.array([1]))[0])


def unit_of(n):
    """Size of a coordinate's unit for a set of ``n``: a power of two, with an average count below 128 units."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (128 * GROUPS)))).astype(np.int64)


def coordinates(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts; the highest code stands for any number."""
    raw = points.astype(np.int64).view(np.uint8).reshape(-1, GROUPS).astype(np.int64)
    # a posting's size is cut at the most it can tell, which makes the bounds wider but never wrong
    return np.where(raw == 255, np.where(sizes >= _SIZE, 1 << 40, sizes)[:, None], raw * unit_of(sizes)[:, None])


def needed(m, n, percent: int):
    """The least overlap of sets of ``m`` and ``n`` whose Jaccard is ``percent`` or more."""
    return -(-(percent * (m + n)) // (100 + percent))


class CountTree:
    """A bulk-loaded R-tree of one level of boxes: points in order of size, then packed by their two widest coordinates."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, percent: int) -> None:
        self.percent, self.sizes, self.at = percent, sizes, coordinates(points, sizes)
        spread = np.argsort(-self.at.std(axis=0))[:2] if len(sizes) else [0, 0]
        strip = np.arange(len(sizes)) // max(1, int(len(sizes) ** 0.5) // LEAF * LEAF or LEAF)
        by_size = np.argsort(sizes, kind="stable")
        strips = np.empty(len(sizes), np.int64)
        strips[by_size] = strip
        self.order = np.lexsort((self.at[:, spread[1]], self.at[:, spread[0]], strips))
        edges = np.arange(0, len(sizes), LEAF)
        self.filled = np.diff(edges, append=len(sizes))
        self.most = np.maximum.reduceat(self.at[self.order], edges, axis=0)
        self.low, self.high = (f.reduceat(sizes[self.order], edges) for f in (np.minimum, np.maximum))

    def near(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Other entries whose bound lets them reach the needed overlap with ``k``, and the Jaccard that it allows."""
        _, entries, ratio = self._near(np.array([k]))
        return entries, ratio

    def all_near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``near`` of every entry, as arrays (entry, other, ratio), for as many entries at once as give up to PAIRS pairs."""
        step = max(1, PAIRS // max(1, len(self.sizes)))
        for begin in range(0, len(self.sizes), step):
            yield self._near(np.arange(begin, min(begin + step, len(self.sizes))))

    def _near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n = self.percent, self.sizes[rows][:, None]
        open_ = (100 * self.high >= p * n) & (p * self.low <= 100 * n)
        at, leaf = np.nonzero(open_)
        k = rows[at]
        least = needed(self.sizes[k], np.maximum(self.low[leaf], -(-p * self.sizes[k] // 100)), p)
        fits = np.minimum(self.at[k], self.most[leaf]).sum(axis=1) >= least
        k, leaf = k[fits], leaf[fits]
        lengths = self.filled[leaf]
        i = np.repeat(k, lengths)
        places = np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        j = self.order[np.repeat(leaf * LEAF, lengths) + places]
        n, m = self.sizes[i], self.sizes[j]
        fits = (100 * np.minimum(m, n) >= p * np.maximum(m, n)) & (i != j)
        i, j, m, n = i[fits], j[fits], m[fits], n[fits]
        bound = np.minimum(self.at[i], self.at[j]).sum(axis=1)
        fits = bound >= needed(n, m, p)
        i, j, m, n = i[fits], j[fits], m[fits], n[fits]
        bound = np.minimum(bound[fits], np.minimum(m, n))
        return i, j, bound / (m + n - bound)

    def first_near(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each entry and the first before it in ``order`` that is near, or else that its bound allows."""
        pairs = []
        for i, j, ratio in self.all_near():
            before = order[j] < order[i]
            i, j, ratio = i[before], j[before], ratio[before]
            pairs.append(_first_of(i, j, np.lexsort((order[j], ratio < NEAR, i))))
        return tuple(np.concatenate(x) for x in zip(*pairs))


def _first_of(i: np.ndarray, j: np.ndarray, order: np.ndarray, *within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in an ``order`` that begins with ``i`` (and ``within``), the first for each."""
    new = np.zeros(len(i), bool)
    new[:1] = True
    for column in (i, *within):
        new[1:] |= column[order][1:] != column[order][:-1]
    return i[order][new], j[order][new]


POSTING = "slot long, a long, b long, point long"  # slot: 40 bits of the shingle, 24 bits of the set's size
PAIR = "a1 long, b1 long, a2 long, b2 long"
_SIZE = (1 << 24) - 1
#: Blocks that a cell's number tells apart.
_PLACES = 1_000_000


def _small_runs(run: np.ndarray, sizes: np.ndarray, points: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of trees that are a single leaf, for many runs at once."""
    at = coordinates(points, sizes)
    for k in range(1, LEAF):
        i = np.flatnonzero(run[k:] == run[:-k])
        if not len(i):
            return
        j = i + k
        fits = (np.minimum(at[i], at[j]).sum(axis=1) >= needed(sizes[i], sizes[j], percent)) & (
            100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        yield i[fits], j[fits]


def _pair_batch(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    swap = (a[i] > a[j]) | ((a[i] == a[j]) & (b[i] > b[j]))
    x, y = np.where(swap, j, i), np.where(swap, i, j)
    once = np.unique(np.stack([a[x], b[x], a[y], b[y]]), axis=1) if len(x) else np.zeros((4, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(v) for v in once], ["a1", "b1", "a2", "b2"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches of whole runs of one shingle, as arrays, without repeats of a class in a run; a run of more than BLOCK sets
    comes in parts, and the last array tells the rows of such runs."""
    held, begun = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        columns = _distinct(columns)
        token = columns[0] >> 24
        last, split = int(np.searchsorted(token, token[-1])), token == begun
        if len(token) - last > BLOCK:
            # the last set stands for the part that goes ahead, so that what follows is not alone
            split[last:], begun = True, int(token[-1])
            held, last = [c[-1:] for c in columns], len(token)
        else:
            held = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in (*columns, split)]
    if held is not None and len(held[0]):
        yield [*held, held[0] >> 24 == begun]


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Without repeats of a class in a run (rows are sorted)."""
    slot, a, b = columns[:3]
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [c[new] for c in columns]


def _shared(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Without runs of one class."""
    token = columns[0] >> 24
    alone = np.ones(len(token), bool)
    alone[1:] &= token[1:] != token[:-1]
    alone[:-1] &= token[1:] != token[:-1]
    return [c[~alone] for c in columns]


def _search(percent: int):
    """Of sorted postings, the candidate pairs (a, b, a2, b2): all of small runs, one for each set of large ones; and the
    postings (slot, a, b, point) of large runs, whose other pairs are looked for later."""
    names = ["slot", "a", "b", "point", "a2", "b2"]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            slot, a, b, points, split = _shared(columns)
            if not len(slot):
                continue
            token, sizes = slot >> 24, slot & _SIZE
            _, run, count = np.unique(token, return_inverse=True, return_counts=True)
            small = np.flatnonzero(count[run] <= LEAF)
            found = [(small[i], small[j]) for i, j in _small_runs(run[small], sizes[small], points[small], percent)]
            begins = np.cumsum(count) - count
            for r in np.flatnonzero(count > LEAF):
                for begin in range(begins[r], begins[r] + count[r], BLOCK):
                    # blocks overlap by one set, so that copies hang together from the first to the last
                    rows = np.arange(max(begins[r], begin - 1), min(begin + BLOCK, begins[r] + count[r]))
                    i, j = CountTree(sizes[rows], points[rows], percent).first_near(a[rows])
                    found.append((rows[i], rows[j]))
            # what is left of a run in parts may be few
            large = (count[run] > LEAF) | split
            none = pa.nulls(int(large.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c[large]) for c in (slot, a, b, points)), none, none], names)
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                pairs = _pair_batch(a, b, i, j)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pairs[0], pairs[1], none, pairs[2], pairs[3]], names)
    return search


class FineCounts:
    """The fine points of sets, to be compared at the fewer groups of a pair. A set is kept at its own number of
    groups and at half of it; sets of a pair differ less in size."""

    def __init__(self, raw: list[bytes] | np.ndarray, sizes: np.ndarray) -> None:
        self.length = np.array([len(x) for x in raw], np.int64)
        self.place: dict[int, np.ndarray] = {}
        self.planes: dict[int, np.ndarray] = {}
        self.rest: dict[int, np.ndarray] = {}
        for few in np.unique(self.length).tolist():
            same, twice = np.flatnonzero(self.length == few), np.flatnonzero(self.length == 2 * few)
            words_ = few // 16  # of a plane
            full = np.frombuffer(b"".join(raw[k] for k in same.tolist()), np.uint64).reshape(-1, 2, words_)
            wide = np.frombuffer(b"".join(raw[k] for k in twice.tolist()), np.uint64).reshape(-1, 2, 2, words_)
            # the low bits are the group: halves fall together
            one, two = wide[:, 0], wide[:, 1]
            folded = np.stack([one[:, 0] | one[:, 1], two[:, 0] | two[:, 1] | (one[:, 0] & one[:, 1])], axis=1)
            rows = np.concatenate([same, twice])
            planes = np.concatenate([full, folded]).reshape(len(rows), -1)
            self.place[few] = np.full(len(raw), -1)
            self.place[few][rows] = np.arange(len(rows))
            self.planes[few] = planes
            # third and further shingles of a group are not told apart
            self.rest[few] = sizes[rows] - np.bitwise_count(planes).sum(axis=1, dtype=np.int64)

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the entries of each pair can share; more than any size where their numbers of groups are too different."""
        out = np.full(len(i), 1 << 60)
        few = np.minimum(self.length[i], self.length[j])
        fits = np.maximum(self.length[i], self.length[j]) <= 2 * few
        for size in np.unique(few[fits]).tolist():
            every = np.flatnonzero(fits & (few == size))
            for at in np.array_split(every, max(1, len(every) * (size // 8) // PAIRS)):
                x, y = self.place[size][i[at]], self.place[size][j[at]]
                both = np.bitwise_count(self.planes[size][x] & self.planes[size][y]).sum(axis=1, dtype=np.int64)
                out[at] = both + np.minimum(self.rest[size][x], self.rest[size][y])
        return out


def _across(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, own: np.ndarray, i_block: np.ndarray, j_block: np.ndarray,
            raw: list[bytes], percent: int, best: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs of one shingle's cell between different components: all, or each set's best in each component; and
    whether there are others."""
    apart = lambda i, j: (i_block[i] == j_block[i]) | (own[j] != own[i])
    found, more = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], False
    for i, j, ratio in _near_across(points, sizes, component, apart, raw, percent):
        if best:
            every = len(i)
            i, j = _first_of(i, j, np.lexsort((-ratio, component[j], i)), component[j])
            more |= len(i) < every
        found.append((i, j))
    return *(np.concatenate(x) for x in zip(*found)), more


def _near_across(points: np.ndarray, sizes: np.ndarray, component: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 raw: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different components that ``apart`` takes and both bounds let through, and the Jaccard that they allow."""
    if (component == component[0]).all():
        return
    tree, fine = CountTree(np.minimum(sizes, _SIZE), points, percent), FineCounts(raw, sizes)
    for i, j, _ in tree.all_near():
        once = (j < i) & (component[j] != component[i]) & apart(i, j)
        i, j = i[once], j[once]
        bound, total = fine.bounds(i, j), sizes[j] + sizes[i]
        fits = bound >= needed(sizes[j], sizes[i], percent)
        i, j, bound, total = i[fits], j[fits], bound[fits], total[fits]
        yield i, j, bound / np.maximum(total - bound, 1)


def _cells(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows that are equal in the first ``by`` columns, as arrays; rows are sorted by these."""
    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:by]], axis=0)) + 1
        parts = [np.split(c, edges) for c in columns]
        yield from list(zip(*parts))[:-1]
        held = [part[-1] for part in parts]
    if held is not None:
        yield held


def _search_across(percent: int, best: bool):
    """Candidate pairs of rows that are sorted by group, cell and shingle, each once for a group's cell, and the shingles
    that have more of them. A group's fine points come first, once for all its shingles."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine: dict[tuple[int, int], tuple[int, bytes]] = {}
        given: set[int] = set()
        for _, _, token, a, b, *columns, raw in _cells(batches, 3):
            names = zip(a.tolist(), b.tolist())
            if token[0] < 0:
                fine, given = {name: (k, x) for k, (name, x) in enumerate(zip(names, raw))}, set()
                continue
            place, raw = zip(*(fine[name] for name in names))
            i, j, more = _across(*columns, raw, percent, best)
            place = np.array(place)
            code = (np.minimum(place[i], place[j]) * len(fine) + np.maximum(place[i], place[j])).tolist()
            fresh = np.array([k for k, x in enumerate(code) if x not in given], np.int64)
            given.update(code)
            pairs = _pair_batch(a, b, i[fresh], j[fresh])
            marks = pa.array([None] * len(pairs) + [int(token[0])] * more, pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([c, pa.nulls(int(more), pa.int64())]) for c in pairs.columns), marks], [*pairs.schema.names, "open"])
    return search


ASKED = "group long, cell long, a long, b long, c long, own int"


def _asked_across(percent: int):
    """Of rows as in ``_search_across``, the sets (group, cell, a, b, c, own) that have a candidate pair, each once for a
    group's cell: not more than it has sets, however many the pairs are."""
    names = ["group", "cell", "a", "b", "c", "own"]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine: dict[tuple[int, int], tuple[int, bytes]] = {}
        asked = np.zeros(0, bool)
        for group, cell, token, a, b, points, sizes, component, own, i_block, j_block, raw in _cells(batches, 3):
            keys = zip(a.tolist(), b.tolist())
            if token[0] < 0:
                fine, asked = {key: (k, x) for k, (key, x) in enumerate(zip(keys, raw))}, np.zeros(len(a), bool)
                continue
            place, raw = zip(*(fine[key] for key in keys))
            place = np.array(place)
            # a pair of two sets that have been found already tells nothing more
            apart = lambda i, j: ((i_block[i] == j_block[i]) | (own[j] != own[i])) & ~(asked[place[i]] & asked[place[j]])  # noqa: B023, E731
            before = asked[place]
            for i, j, _ in _near_across(points, sizes, component, apart, raw, percent):
                asked[place[i]] = asked[place[j]] = True
            new = asked[place] & ~before
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (group, cell, a, b, component, own)], names)
    return search


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _forest(percent: int):
    """Of whole sets (group, cell, part, a, b, c, own, share, shingles) sorted by group, cell and part, links that join all
    components which any link of the part joins: fewer than the part has sets. The likeliest pairs are verified first, and
    none whose components have been joined."""
    def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell, part, a, b, c, own, share, raw in _cells(batches, 3):
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            component = np.unique(c, return_inverse=True)[1]
            root = list(range(len(sets)))  # of components, of which there are not more than sets

            def find(k: int) -> int:
                while root[k] != k:  # noqa: B023
                    root[k] = root[root[k]]  # noqa: B023
                    k = root[k]  # noqa: B023
                return k

            # a cell or part of two different blocks only has the pairs between them
            cross, aside = (x[0] // _PLACES != x[0] % _PLACES for x in (cell, part))
            apart = lambda i, j: ((own[j] != own[i]) | (not cross)) & ((share[j] != share[i]) | (not aside))  # noqa: B023, E731
            links = []
            sizes, points = np.array([len(s) for s in sets]), np.array([point(s) for s in sets])
            for i, j, ratio in _near_across(points, sizes, component, apart, [fine_point(s) for s in sets], percent):
                for k in np.argsort(-ratio, kind="stable").tolist():
                    x, y = int(i[k]), int(j[k])
                    p, q = find(int(component[x])), find(int(component[y]))
                    if p != q and _similar(sets[x], sets[y], percent):
                        root[p] = q
                        links.append((x, y))
            if links:
                i, j = np.array(links).T
                yield _pair_batch(a, b, i, j)
    return forest


def _profiles(n_words: int):
    """(doc_id, n, a, b, fine, t) of each row (``t``: the text's hash), and at a task's end (bucket, count) where its share of the sketch is far above the mean."""
    def profiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        names = ["doc_id", "n", "a", "b", "fine", "t", "bucket", "count"]
        for batch in batches:
            for at, data, offsets in grouped(batch.column(1)):
                sets = shingle_sets(data, offsets, n_words)
                # each distinct set counts once here: what copies repeat is not a passage that others share
                signs = [signature(s) for s in sets]
                fresh = {x: k for k, x in enumerate(signs)}
                every = np.concatenate([sets[k] for k in fresh.values()])
                sketch += np.bincount((every >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([x for x, _ in signs], pa.int64()), pa.array([x for _, x in signs], pa.int64()),
                     pa.array([fine_point(s) for s in sets], pa.binary()), batch.column(2).slice(at, len(sets)), none, none], names)
        heavy = np.flatnonzero(sketch >= 16 + 4 * sketch.mean())
        none = pa.nulls(len(heavy), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(heavy), pa.binary()), none, pa.array(heavy), pa.array(sketch[heavy])], names)
    return profiles


def _postings(levels: np.ndarray, n_words: int, percent: int):
    """Each distinct set under the first shingles of its order."""
    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, data, offsets in grouped(batch.column(0)):
                slots, owners, counts = [], [], []
                for s in shingle_sets(data, offsets, n_words):
                    sign = signature(s)
                    if not len(s) or sign in seen:
                        continue
                    seen.add(sign)
                    n = len(s)
                    order = np.argsort(levels[(s >> np.uint64(46)).astype(np.int64)], kind="stable")
                    first = s[order[: n - -(-percent * n // 100) + 1]]
                    slots.append(((first >> np.uint64(24)).astype(np.int64) << 24) | min(n, _SIZE))
                    owners.append((*sign, point(s)))
                    counts.append(len(first))
                if len(seen) > 200_000:
                    seen.clear()
                if slots:
                    own = np.repeat(np.array(owners, np.int64), counts, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), *(pa.array(own[:, k]) for k in range(3))],
                                                     ["slot", "a", "b", "point"])
    return postings


def _wanted_sets(bitmap: np.ndarray, n_words: int):
    """The sets of texts whose hash is in the bitmap; the others are passed over as they are."""
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column(1).to_numpy() % BITMAP)))
            for _, data, offsets in grouped(batch.column(0)):
                rows = []
                for s in shingle_sets(data, offsets, n_words):
                    sign = signature(s)
                    if len(s) and sign not in seen:
                        seen.add(sign)
                        rows.append((*sign, s.tobytes()))
                if len(seen) > 200_000:
                    seen.clear()
                a, b, raw = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(raw, pa.binary())], ["a", "b", "shingles"])
    return sets


def _verified(percent: int):
    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                keep.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], ["a1", "b1", "a2", "b2"]).filter(pa.array(keep, pa.bool_()))
    return verified


def _refined(percent: int):
    def refined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, m, n = (batch.column(k).to_pylist() for k in range(4, 8))
            keep = [fine_bound(*row) >= needed(row[2], row[3], percent) for row in zip(x, y, m, n)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], ["a1", "b1", "a2", "b2"]).filter(pa.array(keep, pa.bool_()))
    return refined


def refined_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the finer counts let reach the needed overlap; ``classes`` has (a, b, n, fine)."""
    side = lambda k: classes.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"f{k}"))
    full = pairs.hint("merge").join(side(1).hint("merge"), ["a1", "b1"]).join(side(2).hint("merge"), ["a2", "b2"])
    return store(full.select("a1", "b1", "a2", "b2", "f1", "f2", "n1", "n2").mapInArrow(_refined(percent), PAIR), "join-refined")


def links_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough; ``classes`` has (a, b, n, t), ``t`` the hash of a text with that set."""
    sets = sets_of(docs, wanted(classes, ends_of(pairs)), n_words)
    side = lambda k: sets.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("shingles").alias(f"s{k}"))
    full = pairs.hint("merge").join(side(1), ["a1", "b1"]).join(side(2).hint("merge"), ["a2", "b2"]).select("a1", "b1", "a2", "b2", "s1", "s2")
    return full.mapInArrow(_verified(percent), PAIR)


def wanted(classes: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b, n, t) of the classes in ``ends``, which has each once."""
    return store(classes.select("a", "b", "n", "t").join(ends.hint("merge"), ["a", "b"]), "join-ends")


def sets_of(docs: DataFrame, ends: DataFrame, n_words: int) -> DataFrame:
    """(a, b, shingles) of the classes in ``ends``, made from the texts again."""
    bitmap = bitmap_of(ends.select(F.pmod("t", F.lit(BITMAP)).alias("bit")), BITMAP)
    sets = docs.select("text", F.xxhash64("text").alias("t")).mapInArrow(_wanted_sets(bitmap, n_words), "a long, b long, shingles binary")
    sets = sets.join(ends, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("shingles").alias("shingles"))
    return store(sets, "join-sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")),
                                          F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")))).alias("e")).select("e.*").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(a, b, c): the component of each linked class, named by its least member.

    Every class takes the least name among its neighbours' and then the name that
    one has by now, until nothing changes; names jump, so rounds are few. Each
    round is a combined minimum and two joins on written tables.
    """
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = store(links.select(F.explode(F.array(
        F.struct(node("a1", "b1").alias("x"), node("a2", "b2").alias("y")),
        F.struct(node("a2", "b2").alias("x"), node("a1", "b1").alias("y")))).alias("e")).select("e.*"), "join-edges")
    names = store(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("c")), "join-names")
    while True:
        other = names.select(F.col("x").alias("y"), F.col("c").alias("c_y"))
        offered = both.join(other, "y").groupBy("x").agg(F.min("c_y").alias("least"))
        nearer = store(names.join(offered, "x").select("x", F.col("c").alias("was"), F.least("c", "least").alias("c")), "join-names")
        jump = nearer.select(F.col("x").alias("c"), F.col("c").alias("further"))
        nearer = store(nearer.join(jump, "c", "left").select("x", "was", F.least("c", F.coalesce("further", "c")).alias("c")), "join-names")
        names = nearer.select("x", "c")
        if nearer.where(F.col("was") != F.col("c")).isEmpty():
            return names.select("x.a", "x.b", F.concat_ws(":", "c.a", "c.b").alias("c"))


def connected_further(names: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``names`` (a, b, c) after more links: each end stands for its component, and only what is between
    different components goes into the rounds, once."""
    side = lambda k: names.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("c").alias(f"c{k}"))
    # a component is named by one of its members
    end = lambda k, at: F.coalesce(F.split(f"c{k}", ":")[at].cast("long"), F.col(f"{'ab'[at]}{k}")).alias(f"{'ab'[at]}{k}")
    between = links.join(side(1), ["a1", "b1"], "left").join(side(2), ["a2", "b2"], "left").select(
        end(1, 0), end(1, 1), end(2, 0), end(2, 1)).where((F.col("a1") != F.col("a2")) | (F.col("b1") != F.col("b2"))).distinct()
    further = store(connected(between), "join-further")
    named = names.join(further.select(F.concat_ws(":", "a", "b").alias("c"), F.col("c").alias("now")), "c", "left")
    return named.select("a", "b", F.coalesce("now", "c").alias("c")).unionByName(further.join(names, ["a", "b"], "left_anti"))


def asked_across(shared: DataFrame, names: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(group, cell, a, b, c, own): the sets that, by both bounds, may be linked with one of another component under one of
    a group's shingles; the other is among them too."""
    name = F.coalesce("c", F.concat_ws(":", "a", "b"))
    placed = store(shared.join(names, ["a", "b"], "left").select(
        F.shiftright("slot", 24).alias("token"), "slot", "a", "b", "point", F.xxhash64(name).alias("c")), "join-placed")
    # shingles with the same sets ask the same: one of them is enough. Sums of 30 bits don't overflow
    h1, h2 = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    parts = {f"s{k}": F.sum(x) for k, x in enumerate(f(h) for h in (h1, h2) for f in (
        lambda h: F.shiftrightunsigned(h, 34), lambda h: h.bitwiseAND(F.lit((1 << 30) - 1))))}
    open_ = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(h1).alias("first"), *[x.alias(k) for k, x in parts.items()]).where(
        (F.col("n") > LEAF) & (F.col("c1") != F.col("c2"))).groupBy("n", "first", *parts).agg(F.min("token").alias("token")).withColumn(
        "blocks", F.ceil(F.col("n") / (WIDER * BLOCK)).cast("int"))
    # shingles of one block with the same first set have most sets in common: as a group, they need each fine point once.
    # The more sets, the fewer shingles a group has
    part = F.xxhash64("first", F.pmod("token", F.ceil(F.col("n") / GROUP)))
    open_ = open_.select("token", "blocks", F.when(F.col("blocks") == 1, part).otherwise(F.col("token")).alias("group"))
    own = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    # every set goes to the pairs of its block with each block
    members = placed.join(open_, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = store(members.select(
        "group", _cell("own", "other").alias("cell"), "token", "a", "b", "point",
        F.col("slot").bitwiseAND(F.lit(_SIZE)).alias("size"), "c", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "join-dealt")
    fine = dealt.select("group", "cell", "a", "b").distinct().join(classes.select("a", "b", "fine").hint("merge"), ["a", "b"])
    none = [F.lit(0).cast(dealt.schema[name].dataType).alias(name) for name in ("point", "size", "c", "own", "i", "j")]
    rows = dealt.withColumn("fine", F.lit(None).cast("binary")).unionByName(
        fine.select("group", "cell", F.lit(-1).cast("long").alias("token"), "a", "b", *none, "fine"))
    return rows.repartition("group", "cell").sortWithinPartitions("group", "cell", "token", "size").mapInArrow(
        _asked_across(percent), ASKED)


def _cell(own: str, other: str) -> Column:
    """The number of two blocks, in either order."""
    return (F.least(own, other).cast("long") * _PLACES + F.greatest(own, other)).cast("long")


def links_across(docs: DataFrame, asked: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links that join all components which any link within a cell of ``asked`` joins."""
    ends = wanted(classes, asked.select("a", "b").distinct())
    sets = sets_of(docs, ends, n_words)
    parts = asked.join(ends.select("a", "b", "n"), ["a", "b"]).groupBy("group", "cell").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts"))
    dealt = asked.join(parts, ["group", "cell"]).withColumn("share", F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part", _cell("share", "other"))
    whole = dealt.hint("merge").join(sets.hint("merge"), ["a", "b"]).select("group", "cell", "part", "a", "b", "c", "own", "share", "shingles")
    return whole.repartition("group", "cell", "part").sortWithinPartitions("group", "cell", "part").mapInArrow(_forest(percent), PAIR).distinct()


def components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    profile = store(rows.mapInArrow(_profiles(n_words), "doc_id long, n long, a long, b long, fine binary, t long, bucket long, count long"), "join-profiles")
    heavy = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n"))
    levels = np.zeros(SKETCH, np.uint8)
    for row in heavy.collect():  # at most SKETCH rows
        levels[row["bucket"]] = min(255, int(row["n"]).bit_length())
    made = docs.select("text").mapInArrow(_postings(levels, n_words, percent), POSTING)
    dealt = made.repartition(F.shiftright("slot", 24)).sortWithinPartitions("slot", "a", "b")
    searched = store(dealt.mapInArrow(_search(percent), POSTING + ", a2 long, b2 long"), "join-searched")
    shared = searched.where("slot is not null").select("slot", "a", "b", "point")
    pairs = store(searched.where("slot is null").select(F.col("a").alias("a1"), F.col("b").alias("b1"), "a2", "b2").distinct(), "join-pairs")
    classes = profile.where("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("fine").alias("fine"), F.min("t").alias("t"))
    links = store(links_of(docs, refined_pairs(pairs, classes, percent), classes, n_words, percent), "join-links")
    names = store(connected(links), "join-components")

    # shingles with more sets than a leaf and with several components left: every set that may have a link between them
    asked = store(asked_across(shared, names, classes, percent), "join-asked")
    if not asked.isEmpty():
        links = store(links_across(docs, asked, classes, n_words, percent), "join-links")
        if not links.isEmpty():
            names = store(connected_further(names, links), "join-components")

    own_rows = profile.where("bucket is null").drop("fine", "t")
    named = own_rows.join(names, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.concat_ws(":", "a", "b")))
    least = named.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
