"""Packing: plans on many lengths, and whole packings against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from parterre.llm import packing as P
from parterre.llm.queries import tokenizer_path

SHAPES = {
    "uniform": lambda rng, n: rng.integers(1, 65, n),
    "short": lambda rng, n: rng.integers(1, 6, n),
    "long": lambda rng, n: rng.integers(30, 65, n),
    "middle": lambda rng, n: rng.integers(16, 26, n),
    "few": lambda rng, n: rng.choice([7, 21, 22, 43, 64], n),
    "one": lambda rng, n: np.full(n, 21),
}


def best_fit_one_by_one(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, gap in enumerate(gaps) if gap >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("shape", SHAPES)
def test_plans_hold_every_piece_once(shape):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 17, 150, 1500):
        lengths = SHAPES[shape](rng, n)
        counts = np.bincount(lengths, minlength=65)
        plan = P.packing_plan(counts)
        held = defaultdict(int)
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= 64
            for length in pattern:
                held[length] += times
        assert held == {k: c for k, c in enumerate(counts) if c}
        used = sum(times for _, times in plan)
        assert used >= -(-int(lengths.sum()) // 64)
        assert n > 200 or used <= best_fit_one_by_one(lengths.tolist(), 64)


def test_exact_complements():
    counts = np.bincount([3, 3, 5, 9, 20], minlength=41)
    index = P.Complements(counts)
    assert index.filling(20, {}, 1) == [20] and index.filling(14, {}, 3) == [9, 5] and index.filling(6, {}, 2) == [3, 3]
    assert index.filling(6, {3: 1}, 3) is None and index.filling(17, {}, 3) == [9, 5, 3] and index.filling(17, {}, 2) is None
    assert index.filling(15, {}, 3) == [9, 3, 3] and index.filling(15, {3: 1}, 3) is None


def check(rows, docs, size, end_id=0):
    library = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = (len(ids) - 1) % size + 1
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_packing_equals_the_library(spark):
    docs = [(k, f"Document {k} " + "says things and more. " * (k % 17)) for k in range(60)]
    docs += [(60, None), (61, ""), (None, "no id"), (None, None), (5, "twice"), (5, "twice"), (62, "long Éa 漢 word's " * 3000),
             (63, "y" * 50_000), (64, "<|endoftext|> inside")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, shard string, length int").repartition(3)
    packed = P.best_fit_packing(frame, tokenizer_path(), size=128, with_ids=True)
    rows = packed.collect()
    total = sum(r.length for r in rows)
    assert check(rows, docs, 128) <= -(-total // 128) + 1
    whole = P.sequences(packed).collect()
    assert sum(r.length for r in whole) == total and all(len(r.ids) == 4 * r.length for r in whole)


def test_packing_of_nothing(spark):
    assert P.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
