"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a segment forwards and backwards, labels every
position with a distribution over languages, and a document's log-probabilities
are pooled over all its positions. Segments are words (runs of letters, long
ones in parts) with a blank on either side; the state starts anew at each. So
equal segments have equal outputs, and each distinct one is run once.

Training is back-propagation through time in numpy, on the words of a bounded
sample of documents with a language, chosen by the hash of their ids. Words are
drawn in proportion to how often they occur, so frequent ones weigh most.

Null texts and texts without a letter are ``und`` with score 0. Equal texts get
equal answers. Documents without a language are never trained on; where no
language is known at all every answer is ``und``. ``doc_id`` only chooses
training rows.
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

#: Most training documents of a language, chosen by the hash of their ids, and most words drawn from them.
MOST_DOCUMENTS, MOST_WORDS = 300, 24_000
HIDDEN, LONGEST, EPOCHS, BATCH, RATE = 16, 24, 4, 256, 0.01
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """A gated recurrent layer that reads a batch of byte sequences in one direction."""

    NAMES = ("embed", "hidden", "new_hidden")

    def __init__(self, rng: np.random.Generator, size: int) -> None:
        self.size = size
        # the input's part of all gates is a row for each byte; gates are update, reset, new
        self.embed = rng.normal(0, 0.3, (256, 3 * size)).astype(np.float32)
        self.hidden = rng.normal(0, 1 / size**0.5, (size, 2 * size)).astype(np.float32)
        self.new_hidden = rng.normal(0, 1 / size**0.5, (size, size)).astype(np.float32)

    def run(self, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """(states after each step, what the way back needs); ``data`` is (steps, batch)."""
        n = self.size
        h = np.zeros((data.shape[1], n), np.float32)
        states, kept = np.empty((*data.shape, n), np.float32), []
        for t in range(len(data)):
            x = self.embed[data[t]]
            gates = _sigmoid(x[:, : 2 * n] + h @ self.hidden)
            update, reset = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n:] + (reset * h) @ self.new_hidden)
            on = mask[t][:, None]
            kept.append((h, update, reset, new, on))
            h = np.where(on, (1 - update) * h + update * new, h)
            states[t] = h
        return states, kept

    def back(self, data: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, from those of the states."""
        n = self.size
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        d_h = np.zeros_like(d_states[0])
        for t in range(len(data) - 1, -1, -1):
            h, update, reset, new, on = kept[t]
            d_h = d_h + d_states[t]
            live = d_h * on
            d_new = live * update * (1 - new**2)
            d_update = live * (new - h) * update * (1 - update)
            inner = d_new @ self.new_hidden.T
            d_reset = inner * h * reset * (1 - reset)
            d_gates = np.concatenate((d_update, d_reset), axis=1)
            grads["new_hidden"] += (reset * h).T @ d_new
            grads["hidden"] += h.T @ d_gates
            np.add.at(grads["embed"], data[t], np.concatenate((d_gates, d_new), axis=1))
            d_h = np.where(on, live * (1 - update) + inner * reset + d_gates @ self.hidden.T, d_h)
        return grads


@dataclass
class Model:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray

    @staticmethod
    def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words between blanks as (steps, batch), and which places are theirs."""
        sizes = np.array([len(w) for w in words]) + 2
        data = np.full((len(words), int(sizes.max(initial=1))), 32, np.uint8)
        for k, w in enumerate(words):
            data[k, 1: len(w) + 1] = np.frombuffer(w, np.uint8)
        return data.T.copy(), (np.arange(data.shape[1])[:, None] < sizes[None, :])

    def _states(self, data: np.ndarray, mask: np.ndarray):
        ahead, kept_a = self.forward.run(data, mask)
        behind, kept_b = self.backward.run(data[::-1], mask[::-1])
        both = np.concatenate((ahead, behind[::-1], np.ones((*data.shape, 1), np.float32)), axis=2)
        return both, kept_a, kept_b

    def positions(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages at each position."""
        scores = self._states(data, mask)[0] @ self.out
        scores -= scores.max(axis=2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """The sum over its positions for each word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")  # words of like length together
        for at in range(0, len(words), 4096):
            part = order[at: at + 4096]
            data, mask = self.padded([words[k] for k in part])
            out[part] = (self.positions(data, mask) * mask[:, :, None]).sum(axis=0)
        return out

    def step(self, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """The mean loss over positions, and (parameter, gradient) pairs."""
        both, kept_a, kept_b = self._states(data, mask)
        scores = both @ self.out
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        total = mask.sum()
        every = np.arange(data.shape[1])
        loss = -float((np.log(p[:, every, labels] + 1e-12) * mask).sum() / total)
        d = p
        d[:, every, labels] -= 1
        d *= mask[:, :, None] / total
        d_both = d @ self.out.T
        n = self.forward.size
        pairs = [(self.out, np.einsum("tbi,tbj->ij", both, d))]
        for layer, kept, seen, d_states in (
                (self.forward, kept_a, data, d_both[:, :, :n]), (self.backward, kept_b, data[::-1], d_both[::-1, :, n: 2 * n])):
            grads = layer.back(seen, kept, d_states)
            pairs += [(getattr(layer, k), grads[k]) for k in layer.NAMES]
        return loss, pairs


def train(texts: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5) -> Model | None:
    """The model of (text, language) pairs; None without any language."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    words, labels = [], []
    for text, lang in sorted(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, stops, _ = letter_runs(data, np.array([0, len(data)]), LONGEST)
        raw = data.tobytes()
        words += [raw[a:b].lower() for a, b in zip(starts.tolist(), stops.tolist())]
        labels += [languages.index(lang)] * len(starts)
    labels = np.array(labels)
    chosen = []
    for k in range(len(languages)):  # as many of each language
        own = np.flatnonzero(labels == k)
        chosen.append(rng.choice(own, min(len(own), MOST_WORDS // len(languages)), replace=False) if len(own) else own)
    chosen = np.concatenate(chosen)
    model = Model(languages, Direction(rng, hidden), Direction(rng, hidden), rng.normal(0, 0.2, (2 * hidden + 1, len(languages))).astype(np.float32))
    moments: dict[int, list[np.ndarray]] = {}
    step = 0
    total = max(1, epochs * -(-len(chosen) // BATCH))
    for _ in range(epochs):
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            part = chosen[at: at + BATCH]
            data, mask = model.padded([words[k] for k in part])
            _, pairs = model.step(data, mask, labels[part])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, (value, grad) in enumerate(pairs):  # Adam
                first, second = moments.setdefault(k, [np.zeros_like(value), np.zeros_like(value)])
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def training_texts(docs: DataFrame, most: int) -> list[tuple[str, str]]:
    """Up to ``most`` documents of each language from outside the held-out fold, by the hash of their ids."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_remainder(F.col("doc_id")) != 1)).select(
        "doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    found: list[tuple[str, str]] = []
    for lang, n in sorted(counts.items()):
        near = known.where((F.col("lang") == lang) & (place < int((1 << 20) * min(1.0, 2 * most / n + 1e-4))))
        found += [(r["text"], lang) for r in near.orderBy(place, "doc_id", "text").limit(most).select("text").collect()]
    return found


def label_documents(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (the share of the best language, after pooling)."""
    rows = docs.select(F.struct(*keep).alias("kept"), "text")
    if model is None:
        return rows.select("kept.*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kept_type = rows.schema["kept"].dataType.simpleString()

    def labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        memo = WordMemo(model.pooled, n)
        for batch in batches:
            total, places = np.zeros((batch.num_rows, n)), np.zeros(batch.num_rows)
            letters = np.zeros(batch.num_rows, bool)
            for at, data, offsets in grouped(batch.column(1)):
                starts, stops, of = letter_runs(data, offsets, LONGEST)
                if not len(starts):
                    continue
                first = np.flatnonzero(np.diff(of, prepend=-1))
                total[at + of[first]] = np.add.reduceat(memo(data, starts, stops).astype(float), first)
                places[at + of[first]] = np.add.reduceat(stops - starts + 2, first)
                # beyond ASCII not everything is a letter: only texts without an ASCII one need a look at each character
                plain = np.maximum.reduceat((data[starts] < 128) | (data[stops - 1] < 128), first)
                letters[at + of[first]] = plain
                raw = data.tobytes()
                for row in of[first][~plain].tolist():
                    letters[at + row] = any(c.isalpha() for c in raw[offsets[row]: offsets[row + 1]].decode())
            best = total.argmax(axis=1)
            # mean log-probability of a position, sharpened to that of some twenty positions
            mean = total / np.maximum(places, 1)[:, None] * 20
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            score = np.where(letters, share.max(axis=1) / share.sum(axis=1), 0.0)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["kept", "lang_pred", "score"])

    return rows.mapInArrow(labelled, f"kept {kept_type}, lang_pred string, score double").select("kept.*", "lang_pred", "score")


def language_id(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on ``docs`` with a language and label every document."""
    return label_documents(docs, train(training_texts(docs, most_documents)), keep)
