"""The filter audit against a plain version, and its byte machine and table on their own."""

from itertools import permutations

import numpy as np
import pyarrow as pa

from parterre.llm import filter_audit as A
from parterre.llm.text import grouped

DOCS = "doc_id long, text string, source string, n string, mask string, part string"


def words_of(text):
    out = [""]
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain(docs, labels):
    rows = []
    for k, (doc_id, text, source) in enumerate(docs):
        text, words = text or "", words_of(text or "")
        copy = doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                 any(c in "#$%&*|" for c in text), copy]
        mine = [r for r in labels if r[0] == doc_id and doc_id is not None]
        rows.append((source or "", dict(zip("ABCDE", fails)), any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = set()
    for part in {r[0] for r in rows}:
        removed, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                every = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed[f] += len(gone)
                found.append((part, order, step, len(left), len(gone), len(every) - len(gone),
                              sum(sum(r[1].values()) == 1 for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*row, removed[row[1][row[2] - 1]]) for row in found}
    return out


def test_audit_equals_a_plain_one(spark):
    varied = " ".join(f"w{k}é" for k in range(60))
    docs = [(1, varied, "a"), (2, varied, "a"), (2, varied, "b"), (2, varied, "b"), (None, varied, "a"), (None, None, None), (3, "", ""),
            (4, "same " * 80, "a"), (5, varied.upper(), "b"), (6, varied + " #", "b"), (7, varied + "\x1c |", "b"), (8, None, "c"),
            (9, "　\x0b\t x\x0cy", "c"), (10, "Aé" * 3000, "a"), (11, varied + "\nW", "a"), (12, "same " * 80, "c"), (8, varied, "a")]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (None, 1, 1), (4, 0, 1), (99, 1, 1), (5, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS)
    found = A.interaction_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = found.collect()
    assert len(rows) == 600 * 4 and {tuple(r) for r in rows} == plain(docs, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert A.interaction_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_one_pass_counts():
    texts = ["", "Ab  c#é ", " ", "x", None, "Z|\n漢  q\x0b"]
    (_, data, offsets), = grouped(pa.array(texts, pa.string()))
    seen = A.transduce(data, offsets)
    assert seen["words"].tolist() == [len(words_of(t or "")) for t in texts]
    assert seen["points"].tolist() == [len(t or "") for t in texts]
    assert seen["capitals"].tolist() == [0, 1, 0, 0, 0, 1] and seen["symbols"].tolist() == [0, 1, 0, 0, 0, 1]
    raw = data.tobytes()
    spans = [raw[a:b].decode() for a, b in zip(seen["starts"], seen["stops"])]
    assert spans == [w for t in texts for w in words_of(t or "")]


def test_spans_with_equal_hashes_are_told_apart():
    words = [b"one", b"two", b"one", b"six", b"two", b"three"]
    data = np.frombuffer(b"".join(words), np.uint8)
    stops = np.cumsum([len(w) for w in words])
    starts = stops - [len(w) for w in words]
    row = np.array([0, 0, 0, 0, 1, 1])
    assert A.distinct_spans(data, starts, stops, row, 3, hashed=np.zeros(6, np.uint64)).tolist() == [3, 2, 0]
    assert A.distinct_spans(data, starts, stops, row, 3).tolist() == [3, 2, 0]
