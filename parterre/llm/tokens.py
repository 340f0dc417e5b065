"""Byte-level BPE for batches of texts, exactly as the tokenizers library encodes them.

The library's pre-tokenizer cuts a text into words that are merged independently
of each other. For texts of Latin letters, digits and marks the cuts are found
for a whole batch at once; each distinct word is merged once and its ids are
copied to where it stands. Where a vocabulary's ids follow the order of its
merges, words are merged by tiktoken, which has less overhead a word. Texts with other characters, or with
apostrophes (which the pre-tokenizer treats specially), go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from parterre.llm.text import codes, gather, grouped, span_hashes

LATIN = 0x250
LETTER, DIGIT, SPACE, MARK, WHOLE = range(5)
#: Words kept with their ids; beyond, the store starts anew.
MOST_WORDS = 300_000


def _classes() -> np.ndarray:
    out = np.full(LATIN + 1, MARK, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else SPACE if chr(c).isspace() else MARK
    # besides what is beyond Latin: control characters that not all agree to call space
    out[0] = out[0x1C:0x20] = out[0x85] = out[ord("'")] = out[LATIN] = WHOLE
    return out


_CLASS, _CODES = _classes(), codes(LATIN + 1, seed=5)


def byte_tokens(told: dict) -> list[bytes]:
    """The bytes of each id of a tokenizer's description."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    size = max([*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])]) + 1
    tokens = [b""] * size
    for token, k in told["model"]["vocab"].items():
        tokens[k] = bytes(letters[c] for c in token)
    for t in told["added_tokens"]:
        tokens[t["id"]] = t["content"].encode()
    return tokens


def word_merger(told: dict, tokens: list[bytes]):
    """tiktoken's encoder of words that a zero character divides, or None where merges and ids are ordered differently."""
    import tiktoken

    vocab, special = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    ranks = {tokens[k]: k for token, k in vocab.items() if token not in special}
    if any(a >= b for a, b in zip(made, made[1:])) or len(ranks) != len(made) + 256 or set(range(256)) != {ranks.get(bytes([b])) for b in range(256)}:
        return None
    return tiktoken.Encoding("words", pat_str=r"\x00|[^\x00]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def vocabulary(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where each id's begin."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


class Decoder:
    """Decodes ids; holds the vocabulary's bytes alone."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            self._bytes = vocabulary(byte_tokens(json.load(f)))
        self.size = len(self._bytes[1]) - 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for. Bytes that are no UTF-8 become replacement characters, as the library has it."""
        data, offsets = self._bytes
        at = ids.astype(np.int64)
        raw = gather(data, offsets[at], offsets[at + 1] - offsets[at]).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


class Encoder:
    """Encodes batches; one for each task."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            told = json.load(f)
        self._merge = word_merger(told, byte_tokens(told))
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # sorted hashes of words
        self._place = np.zeros(0, np.int64)  # of their ids in the store
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """By the library itself."""
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null texts have none."""
        ids, counts = [], []
        for _, data, offsets in grouped(texts):
            found, number = self.encode_group(data, offsets)
            ids.append(found)
            counts.append(number)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(ids, np.uint32), join(counts, np.int64)

    def encode_group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        # offsets in code points: a code point is counted at its first byte
        first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offsets_c = first[offsets]
        short = np.minimum(points, LATIN).astype(np.int64)
        kinds = _CLASS[short]
        odd = np.zeros(n, bool)
        at = np.flatnonzero(kinds == WHOLE)
        odd[np.searchsorted(offsets_c, at, "right") - 1] = True
        for token in self._special:
            where = raw.find(token.encode())
            while where >= 0:
                odd[np.searchsorted(offsets, where, "right") - 1] = True
                where = raw.find(token.encode(), where + 1)
        starts = self._cuts(points, kinds, offsets_c)
        stops = np.append(starts[1:], len(points)) if len(starts) else starts
        hashes = span_hashes(_CODES[short], starts, stops)
        of_text = np.searchsorted(offsets_c, starts, "right") - 1
        plain = ~odd[of_text]
        starts, stops, hashes, of_text = starts[plain], stops[plain], hashes[plain], of_text[plain]
        place, size = self._placed(points, starts, stops, hashes)
        if not odd.any():
            return gather(self._ids, place, size), np.bincount(of_text, size, n).astype(np.int64)
        # texts of either kind, in order
        rest = np.flatnonzero(odd)
        by_library = self.ids_of([raw[offsets[k]: offsets[k + 1]].decode() for k in rest])
        counts = np.bincount(of_text, size, n).astype(np.int64)
        counts[rest] = [len(x) for x in by_library]
        ids = np.empty(int(counts.sum()), np.uint32)
        ours = np.repeat(~odd, counts)
        ids[ours] = gather(self._ids, place, size)
        ids[~ours] = np.array([i for x in by_library for i in x], np.uint32)
        return ids, counts

    @staticmethod
    def _cuts(points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words begin: runs of one class, with one blank before; the rest of a white run is a word too."""
        if not len(points):
            return np.zeros(0, np.int64)
        begin = np.zeros(len(points) + 1, bool)
        begin[offsets] = True
        opens, closes = begin[:-1], begin[1:]  # the first and the last character of a text
        white = kinds == SPACE
        before = np.concatenate(([SPACE], kinds[:-1]))
        blank_before = np.concatenate(([False], points[:-1] == 32)) & ~opens
        solid = ~white & (opens | ((before != kinds) & ~blank_before))
        next_solid = np.concatenate((~white[1:], [False])) & ~closes
        gap = white & (opens | (before != SPACE) | next_solid)
        return np.flatnonzero(solid | gap)

    def _placed(self, points, starts, stops, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word are in the store, and how many; new words are encoded first."""
        unique, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) + len(unique) > MOST_WORDS:
            self._forget()
        at = np.searchsorted(self._known, unique)
        seen = at < len(self._known)
        seen[seen] = self._known[at[seen]] == unique[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            chosen = one[new]
            text = points.astype("<u4").tobytes()
            fresh = [text[4 * a: 4 * b].decode("utf-32-le") for a, b in zip(starts[chosen].tolist(), stops[chosen].tolist())]
            ids, size = self._merged(fresh)
            place = len(self._ids) + np.cumsum(size) - size
            self._ids = np.concatenate((self._ids, ids))
            hashes_all = np.concatenate((self._known, unique[new]))
            order = np.argsort(hashes_all, kind="stable")
            self._known = hashes_all[order]
            self._place = np.concatenate((self._place, place))[order]
            self._size = np.concatenate((self._size, size))[order]
            at = np.searchsorted(self._known, unique)
        return self._place[at][back], self._size[at][back]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each). No word holds a zero character: those texts go to the library."""
        if self._merge is None:
            ids = self.ids_of(words)
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        found = np.array(self._merge("\0".join(words) + "\0"), np.uint32)
        ends = np.flatnonzero(found == self._merge("\0")[0])
        return np.delete(found, ends), np.diff(ends, prepend=-1) - 1
