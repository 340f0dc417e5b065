"""BPE encoding that encodes content shared between documents once.

A rolling hash over the bytes cuts texts into chunks, so that copies and shared
passages cut alike wherever they stand. Chunks in more than one document are
encoded once, as far as their encoding cannot depend on what stands around them:
between the first and the last place where a blank stands between letters, since
the pre-tokenizer always cuts there. What lies between two such stretches (the
joins of chunks, and everything unshared) is encoded in its document, and the
decoded whole is compared with the text; where it does not agree, the document
is encoded again by the library at once.

Which chunks are shared is counted over all documents. A bitmap of ``BITMAP``
bits, fixed in size, tells the tasks which chunks may be; a false hit costs a
look-up and nothing else. Documents without shared chunks are not shuffled.

Null and empty texts have no ids. Repeated rows get a row each. A text is held
whole in one task. Only the id and the text are read, and other columns named in ``keep``, which
may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import bitmap_of, in_bitmap, row_key, store, travels
from parterre.llm.text import codes, grouped, mixed, sliced, span_hashes
from parterre.llm.tokens import Decoder, Encoder

travels(__name__, "parterre.llm.common", "parterre.llm.text", "parterre.llm.tokens")

#: Bytes that the rolling hash sees; one place in so many is a cut; shorter chunks are not shared; bits of the bitmap.
ROLL, MEAN, LEAST, BITMAP = 24, 512, 96, 1 << 23

_BYTES = codes(256, seed=9)
_SECOND = codes(256, seed=23)


def chunk_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, a, b): chunks of all texts in order; ``a`` and ``b`` are hashes of their content."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    places = np.arange(ROLL, len(data))
    rolled = span_hashes(_BYTES[data], places - ROLL, places) if len(places) else np.zeros(0, np.uint64)
    cut = places[(rolled & np.uint64(MEAN - 1)) == 0]
    # a cut needs its whole window in one text, and stands between characters
    text_start = offsets[np.searchsorted(offsets, cut, "right") - 1]
    cut = cut[(cut - text_start >= ROLL) & ((data[cut] & 0xC0) != 0x80)]
    begin[cut] = True
    starts = np.flatnonzero(begin[:-1])
    stops = np.append(starts[1:], len(data))
    a = span_hashes(_BYTES[data], starts, stops)
    b = span_hashes(_SECOND[data], starts, stops)
    return starts, stops, a.view(np.int64), b.view(np.int64)


def safe_stretch(chunk: bytes) -> tuple[int, int]:
    """(first, last) blanks between ASCII letters; (0, 0) if there are not two."""
    size, first, last = len(chunk), 0, 0
    at = chunk.find(b" ", 1)
    while 0 < at < size - 1:
        if chunk[at - 1: at].isalpha() and chunk[at + 1: at + 2].isalpha():
            first = at
            break
        at = chunk.find(b" ", at + 1)
    at = chunk.rfind(b" ", 1, size - 1)
    while at > first > 0:
        if chunk[at - 1: at].isalpha() and chunk[at + 1: at + 2].isalpha():
            last = at
            break
        at = chunk.rfind(b" ", 1, at)
    return (first, last) if last > first > 0 else (0, 0)


def _bit(a: np.ndarray) -> np.ndarray:
    return (mixed(a.view(np.uint64)) % np.uint64(BITMAP)).astype(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk that could be shared and each document it is in: (bit, a, b)."""
    for batch in batches:
        for _, data, offsets in grouped(batch.column(0)):
            starts, stops, a, b = chunk_table(data, offsets)
            long = stops - starts >= LEAST
            document = np.searchsorted(offsets, starts[long], "right")
            once = np.unique(np.stack([document, a[long], b[long]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_bit(once[1])), pa.array(once[1]), pa.array(once[2])], ["bit", "a", "b"])


def encode_documents(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``: 4-byte little-endian integers, one after the other."""
    counted = docs.select("text").mapInArrow(_chunks, "bit long, a long, b long").groupBy("bit", "a", "b").agg(F.count("*").alias("n"))
    shared = store(counted.where("n > 1").drop("n"), "bpe-shared")
    bitmap = bitmap_of(shared, BITMAP)
    # two columns, so that kept ones of any name stay apart
    rows = docs.select(F.struct(*keep).alias("kept"), "text", row_key(docs).alias("key"))
    kept_type = rows.schema["kept"].dataType.simpleString()

    def shared_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in grouped(batch.column(0)):
                starts, stops, a, b = chunk_table(data, offsets)
                hits = np.flatnonzero((stops - starts >= LEAST) & in_bitmap(bitmap, _bit(a)))
                fresh = [k for k in hits.tolist() if not (int(a[k]) in seen or seen.add(int(a[k])))]
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[fresh]), pa.array(b[fresh]), pa.array([data[starts[k]: stops[k]].tobytes() for k in fresh], pa.binary())],
                    ["a", "b", "chunk"])

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in sliced(batches, 2000):
            chunks = batch.column(2).to_pylist()
            spans = [safe_stretch(c) for c in chunks]
            ids, sizes = encoder.encode(pa.array([c[x:y].decode() for c, (x, y) in zip(chunks, spans)], pa.string()))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in spans], pa.int32()), pa.array([y for _, y in spans], pa.int32()),
                 pa.array([ids[e - n: e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())],
                ["a", "b", "first", "last", "ids"])

    texts = docs.select("text").mapInArrow(shared_texts, "a long, b long, chunk binary")
    once = texts.groupBy("a", "b").agg(F.first("chunk").alias("chunk")).join(shared.select("a", "b"), ["a", "b"])
    table = store(once.mapInArrow(encoded, "a long, b long, first int, last int, ids binary").where("last > 0"), "bpe-chunks")

    def chosen(batch: pa.RecordBatch, with_hits: bool) -> pa.RecordBatch:
        """Rows whose text may hold shared chunks, or those that surely don't."""
        hit = np.zeros(batch.num_rows, bool)
        for at, data, offsets in grouped(batch.column(1)):
            starts, stops, a, _ = chunk_table(data, offsets)
            hits = (stops - starts >= LEAST) & in_bitmap(bitmap, _bit(a))
            hit[at + np.searchsorted(offsets, starts[hits], "right") - 1] = True
        return batch.filter(pa.array(hit == with_hits))

    def sharing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield chosen(batch, True)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for at, data, offsets in grouped(batch.column(0)):
                starts, stops, a, b = chunk_table(data, offsets)
                hits = np.flatnonzero((stops - starts >= LEAST) & in_bitmap(bitmap, _bit(a)))
                of = np.searchsorted(offsets, starts[hits], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at + of]), pa.array(starts[hits] - offsets[of]), pa.array(a[hits]), pa.array(b[hits])],
                    ["key", "at", "a", "b"])

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in sliced(batches):
            batch = chosen(batch, False)
            ids, sizes = encoder.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _cut(ids, sizes)], ["kept", "ids"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(tokenizer), Decoder(tokenizer)
        for batch in sliced(batches, 200):
            texts, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_assembled(encoder, decoder, texts, parts), pa.binary())], ["kept", "ids"])

    placed = rows.select("text", "key").mapInArrow(places, "key long, at long, a long, b long").distinct().join(table, ["a", "b"])
    stretches = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last")).alias("stop"), "ids"))).alias("parts"))
    reused = rows.mapInArrow(sharing, f"kept {kept_type}, text string, key long").join(stretches.hint("merge"), "key", "left").select("kept", "text", "parts")
    out = f"kept {kept_type}, ids binary"
    return reused.mapInArrow(joined, out).unionByName(rows.drop("key").mapInArrow(alone, out)).select("kept.*", "ids")


def _cut(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
    return pa.array([raw[4 * (e - n): 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())


def _assembled(encoder: Encoder, decoder: Decoder, texts: list[str | None], parts: list[list[dict] | None]) -> list[bytes]:
    """Ids of each text from its shared stretches and what lies between them, which is encoded here."""
    raws = [(t or "").encode() for t in texts]
    gaps = []
    for raw, own in zip(raws, parts):
        edges = [0, *(x for p in own or () for x in (p["start"], p["stop"])), len(raw)]
        gaps.append([raw[edges[k]: edges[k + 1]].decode() for k in range(0, len(edges), 2)])
    ids, sizes = encoder.encode(pa.array([g for own in gaps for g in own], pa.string()))
    between = iter(_cut(ids, sizes).to_pylist())
    out = []
    for raw, own in zip(raws, parts):
        pieces = [next(between)]
        for p in own or ():
            pieces += (p["ids"], next(between))
        whole = b"".join(pieces)
        if own and decoder.decode(np.frombuffer(whole, "<u4")) != raw:
            whole = np.array(encoder.ids_of([raw.decode()])[0], "<u4").tobytes()
        out.append(whole)
    return out


def decode_documents(encoded: DataFrame, tokenizer: str, digest: bool = False) -> DataFrame:
    """``encoded`` with n_tokens and ``decoded`` instead of ids; with ``digest`` also the hash of the ids as text."""
    kept = [c for c in encoded.columns if c != "ids"]
    rows = encoded.select(F.struct(*kept).alias("kept"), "ids")
    kept_type = rows.schema["kept"].dataType.simpleString()

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        decoder = Decoder(tokenizer)
        shown = [str(k) for k in range(decoder.size)] if digest else []
        for part in sliced(batches, 200):
            ids = [np.frombuffer(x or b"", "<u4") for x in part.column(1).to_pylist()]
            texts = [decoder.decode(x).decode() for x in ids]
            hashes = [hashlib.sha256(",".join([shown[k] for k in x.tolist()]).encode()).hexdigest() if digest else None for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(texts, pa.string()), pa.array(hashes, pa.string())],
                ["kept", "n_tokens", "decoded", "ids_sha256"])

    out = rows.mapInArrow(decoded, f"kept {kept_type}, n_tokens long, decoded string, ids_sha256 string")
    return out.select("kept.*", "n_tokens", "decoded", *["ids_sha256"] * digest)
