"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary text, one of toxic text.

A window is one word. It is compressed with the ordinary dictionary alone and
with the toxic one put before it: what toxic text repeats becomes shorter, what
both know stays as it is. The dictionaries are trained on a bounded sample of
labelled documents: the ordinary one by zstandard's trainer on ordinary words,
the toxic one on the words that toxic documents hold many times as often, in
different contexts. The
thresholds are calibrated on the same sample: for each pair of compressed
lengths, how often it occurs in toxic and in ordinary documents gives its
weight; the score of a document is a logistic function of its heaviest window
and of the sum of heavy ones, fitted by numpy.

Null, empty and wordless texts have no window and get the base score of the
sample. Equal texts get equal scores. Without labelled documents of both kinds
every score is 0. ``doc_id`` is used to choose training rows only. A text is held whole in one task; its windows are words, and
equal words are compressed once. Only ``keep``, the id and the text are read, so other columns may have any name. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import fold_remainder, travels
from parterre.llm.text import WordMemo, grouped, letter_runs

travels(__name__, "parterre.llm.common", "parterre.llm.text")

#: Most labelled documents of each kind that the model is trained on, chosen by the hash of their ids.
MOST_TOXIC, MOST_ORDINARY = 1500, 4000
#: Bytes of the dictionaries, the longest window, and the ordinary text put after each window, without which a short
#: one would be stored as it is (no match begins in the last eight bytes); zstandard's strategy (lazy) looks at all places of the dictionary.
ORDINARY_BYTES, TOXIC_BYTES, LONGEST, CARRIER, STRATEGY = 16384, 8192, 64, 32, 4
#: A word is toxic material if this many toxic documents hold it, and so many times the share of ordinary ones.
SEEN, CONTRAST = 4, 40


def windows_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, stops, _ = letter_runs(data, np.array([0, len(data)]), LONGEST)
    raw = data.tobytes()
    return [_window(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]


def _window(word: bytes) -> bytes:
    """A word between delimiters, so that a whole word is a single match."""
    return b"\n" + word.decode(errors="replace").lower().encode() + b"\n"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: dict[tuple[int, int, int], float]
    logistic: tuple[float, float, float]

    def lengths(self):
        """A function from a window to its two compressed lengths."""
        import zstandard

        options = zstandard.ZstdCompressionParameters(
            strategy=STRATEGY, min_match=4, window_log=16, hash_log=15, chain_log=15, search_log=4, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(compression_params=options, dict_data=known)

        # the ordinary part stands at the same distance in both, so that it costs the same
        a, b = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        carrier = self.ordinary[-CARRIER - 1: -1]
        return lambda window: (len(a.compress(window + carrier)), len(b.compress(window + carrier)))

    def weigher(self):
        """A function from words to their windows' weights."""
        lengths = self.lengths()

        def weigh(words: list[bytes]) -> np.ndarray:
            out = np.zeros((len(words), 1), np.float32)
            for k, word in enumerate(words):
                window = _window(word)
                out[k, 0] = self.weights.get((min(len(window), 20), *lengths(window)), 0.0)
            return out
        return weigh

    def score(self, heaviest: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + b * heaviest + c * np.minimum(total, 12), -30, 30)))


def train(toxic_texts: list[str], ordinary_texts: list[str]) -> Model | None:
    """The model, or None if a kind is missing."""
    import zstandard

    toxic_texts, ordinary_texts = sorted(set(toxic_texts)), sorted(set(ordinary_texts))
    if not toxic_texts or not ordinary_texts:
        return None
    known: dict[bytes, int] = {}  # each word is held once and stands as its number, in arrays
    numbers = lambda text: np.fromiter((known.setdefault(w, len(known)) for w in windows_of(text)), np.int32)
    toxic_lists = [numbers(t) for t in toxic_texts]
    sets = [np.unique(x) for x in toxic_lists], [np.unique(numbers(t)) for t in ordinary_texts]
    n = [len(part) for part in sets]
    words = list(known)
    seen = [np.bincount(np.concatenate(part), minlength=len(words)) for part in sets]
    # a passage that copies repeat puts a word after the same one each time: different words before it are counted
    after = np.unique(np.concatenate([np.append(0, x[:-1].astype(np.int64) + 1)[: len(x)] * len(words) + x for x in toxic_lists]))
    contexts = np.bincount(after % max(1, len(words)), minlength=len(words))
    often = np.minimum(seen[0], contexts)
    contrasting = (often >= SEEN) & (often / n[0] >= CONTRAST * (seen[1] + 0.5) / n[1])
    contrast = {words[k]: int(often[k]) for k in np.flatnonzero(contrasting)}
    usual = {words[k]: int(seen[1][k]) for k in np.flatnonzero((seen[1] >= SEEN) & ~contrasting)}
    by_count = lambda found: sorted(found, key=lambda w: (found[w], w))  # noqa: E731  the most frequent last, nearest to the text
    # neighbours share their delimiter
    chain = lambda found, most: b"".join([b"\n", *(w[1:] for w in found)])[-most:]
    toxic = chain(by_count(contrast), TOXIC_BYTES)
    common = by_count(usual)
    samples = [b"".join(common[k: k + 12]) for k in range(0, len(common), 12)]
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        ordinary = chain(common, ORDINARY_BYTES)
    model = Model(ordinary, toxic, {}, (0.0, 0.0, 0.0))
    lengths = model.lengths()
    cells: dict[tuple[int, int, int], int] = {}
    cell = np.fromiter((cells.setdefault((min(len(w), 20), *lengths(w)), len(cells)) for w in words), np.int32, len(words))
    # documents, not words, are counted: a cell's share of toxic ones against its share of ordinary ones
    count = lambda lists: np.bincount(np.concatenate(lists), minlength=len(cells))
    held = sum(count([np.unique(cell[s]) for s in part]) for part in sets)
    windows = [count([cell[s] for s in part]) for part in sets]
    rates = [(w + 0.5) / (w.sum() + 1) for w in windows]
    weights = np.where(held >= 3, np.clip(np.log(rates[0] / rates[1]), -6, 6), 0.0)
    model.weights = {c: float(weights[k]) for c, k in cells.items() if held[k] >= 3}
    rows, labels = [], []
    for label, part in ((1, sets[0]), (0, sets[1])):
        for s in part:
            values = weights[cell[s]]
            rows.append((1.0, values.max() if len(values) else 0.0, min(12.0, sum(values[values > 2].tolist()))))
            labels.append(label)
    model.logistic = _fit(np.array(rows), np.array(labels, float))
    return model


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton's steps, lightly drawn to zero."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return tuple(float(v) for v in w)


def training_texts(docs: DataFrame, labels: DataFrame, label: int, most: int) -> list[str]:
    """Up to ``most`` texts with this label from outside the held-out fold, by the hash of their ids."""
    wanted = labels.where((F.col("toxic") == label) & (fold_remainder(F.col("doc_id")) != 1)).select("doc_id").distinct()
    n = wanted.count()
    # by hash, before texts are read: about twice as many as wanted, of which the first by hash are taken
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * most / max(n, 1)))
    rows = docs.select("doc_id", "text").where("text is not null").join(wanted.where(part), "doc_id", "left_semi")
    return [r["text"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text").collect()]


def score_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``."""
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    if model is None:
        return rows.select("kept.*", F.lit(0.0).alias("score"))
    kept_type = rows.schema["kept"].dataType.simpleString()

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(model.weigher(), 1)
        for batch in batches:
            heaviest, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, data, offsets in grouped(batch.column(1)):
                starts, stops, of = letter_runs(data, offsets, LONGEST)
                if not len(starts):
                    continue
                values = memo(data, starts, stops)[:, 0].astype(float)
                first = np.flatnonzero(np.diff(of, prepend=-1))
                heaviest[at + of[first]] = np.maximum.reduceat(values, first)
                # a word counts once for a document, as in training
                heavy = np.flatnonzero(values > 2)
                raw = data.tobytes()
                once = {(int(of[k]), raw[starts[k]: stops[k]].lower()): values[k] for k in heavy.tolist()}
                for (row, _), value in once.items():
                    total[at + row] += value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(heaviest, total))], ["kept", "score"])

    return rows.mapInArrow(scored, f"kept {kept_type}, score double").select("kept.*", "score")


def toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY,
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) and score every document."""
    model = train(training_texts(docs, labels, 1, most_toxic), training_texts(docs, labels, 0, most_ordinary))
    return score_documents(docs, model, keep)
