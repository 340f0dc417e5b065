"""Token ids in files, with constant-time access by document.

``write_token_files`` encodes documents in ascending order of doc_id and writes
blocks: the raw ids of some thousand documents one after the other, and an index
of a minimal perfect hash (bit arrays level by level: a key that has its bit to
itself stays, the others go on to the next) from document key to slot, with the
offset, length and a stored fingerprint for each slot. Keys are not needed for a
lookup, and an unknown key is told apart by its fingerprint. Blocks are rows of
Parquet files, so any store that Spark reaches can hold them.

``read_token_files`` reads everything back through the index; ``fetch`` gets
single documents, reading only blocks whose range of ids can hold them.

Null text is empty and gets the end id alone. Null ids come first. Rows that
repeat an id are kept apart by their number among equals, ordered by text. An
empty table gives no block. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parterre.llm.common import store, travels
from parterre.llm.text import grouped, mixed
from parterre.llm.tokens import Encoder

travels(__name__, "parterre.llm.common", "parterre.llm.text", "parterre.llm.tokens")

#: Ids of a block, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
BLOCKS = ("shard int, block int, first long, last long, n_docs int, n_ids long, width int, keys binary, repeats binary, "
          "levels binary, bits binary, rest binary, offsets binary, sizes binary, prints binary, payload binary")
#: A null id's place in the arrays of keys; no room is left for a true id of this value, which is 1 - 2**63.
NULL_KEY = -(2**63) + 1


def key_hashes(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return mixed(mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(11)) + repeats.astype(np.uint64))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct hashes, in about three bits a key."""

    LEVELS = 30

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.ranks = np.concatenate(([0], np.cumsum(bits)))

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], hashes
        while len(left) and len(sizes) < cls.LEVELS:
            size = max(16, 2 * len(left))
            at = cls._at(left, len(sizes), size)
            count = np.bincount(at, minlength=size)
            levels.append(count == 1)
            sizes.append(size)
            left = left[count[at] != 1]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), bits, np.sort(left))

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(hashes + np.uint64(level * 0x9E37 + 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each known hash; of an unknown one -1 or any slot."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self._at(hashes[open_], level, size) + self.begins[level]
            found = self.bits[at]
            out[open_[found]] = self.ranks[at[found]]
            open_ = open_[~found]
        if len(open_) and len(self.rest):  # keys that met on every level
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            known = self.rest[at] == hashes[open_]
            out[open_[known]] = self.ranks[-1] + at[known]
        return out


def _block(shard: int, number: int, keys: np.ndarray, repeats: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> dict:
    hashes = key_hashes(keys, repeats)
    index = PerfectHash.build(hashes)
    slots = index.slots(hashes)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots] = np.arange(len(keys))
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return {
        "shard": shard, "block": number, "first": int(keys[0]), "last": int(keys[-1]), "n_docs": len(keys), "n_ids": len(ids), "width": width,
        "keys": keys.astype("<i8").tobytes(), "repeats": repeats.astype("<u4").tobytes(),
        "levels": index.sizes.astype("<i8").tobytes(), "bits": np.packbits(index.bits).tobytes(), "rest": index.rest.astype("<u8").tobytes(),
        "offsets": (np.cumsum(sizes) - sizes)[by_slot].astype("<i8").tobytes(), "sizes": sizes[by_slot].astype("<i8").tobytes(),
        "prints": fingerprints(hashes)[by_slot].astype("<u4").tobytes(), "payload": ids.astype(f"<u{width}").tobytes()}


def _to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t])
                     for n, t in (c.split() for c in BLOCKS.split(", "))])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The written blocks of ``docs`` (doc_id, text)."""
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        held_ids = 0
        previous = (None, -1)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in grouped(batch.column(1)):
                n = len(offsets) - 1
                ids, sizes = encoder.encode_group(data, offsets)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                keys = doc_ids[at: at + n]
                repeats = np.zeros(n, np.int64)
                for k in np.flatnonzero(np.concatenate(([keys[0] == previous[0]], keys[1:] == keys[:-1]))):
                    repeats[k] = (repeats[k - 1] if k else previous[1]) + 1
                previous = (keys[-1], repeats[-1])
                if held and held_ids + len(ids) > block_ids:
                    yield _to_batch([_block(shard, number, *map(np.concatenate, zip(*held)))], _SCHEMA)
                    held, held_ids, number = [], 0, number + 1
                held.append((keys, repeats, ids, sizes))
                held_ids += len(ids)
        if held:
            yield _to_batch([_block(shard, number, *map(np.concatenate, zip(*held)))], _SCHEMA)

    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return store(placed.mapInArrow(blocks, BLOCKS), "token-files")


def _looked_up(row: dict, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, offset, size) of each key in a block."""
    whole = lambda name, kind: np.frombuffer(row[name], kind)
    levels = whole("levels", "<i8")
    bits = np.unpackbits(whole("bits", np.uint8))[: levels.sum()].astype(bool)
    index = PerfectHash(levels, bits, whole("rest", "<u8"))
    hashes = key_hashes(keys, repeats)
    slots = index.slots(hashes)
    found = slots >= 0
    found[found] = whole("prints", "<u4")[slots[found]] == fingerprints(hashes[found])
    return found, whole("offsets", "<i8")[slots], whole("sizes", "<i8")[slots]


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, each found through its block's index."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shard_starts = store(shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start")), "token-starts")
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = store(files.select("shard", "block", "n_ids").withColumn("inside", F.coalesce(inside, F.lit(0))).join(
        shard_starts, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start")), "token-starts")
    names = ["shard", "block", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], "<i8")
                found, offsets, sizes = _looked_up(row, keys, np.frombuffer(row["repeats"], "<u4"))
                if not found.all():
                    raise ValueError(f"block {row['shard']}/{row['block']}: a key is not found by its fingerprint")
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                sums = [zlib.crc32(ids[a: a + n]) for a, n in zip(offsets.tolist(), sizes.tolist())]
                columns = [np.full(len(keys), row["shard"], np.int32), np.full(len(keys), row["block"], np.int32),
                           pa.array(keys, mask=keys == NULL_KEY), offsets, sizes, np.array(sums, np.int64)]
                if with_ids:
                    columns.append(pa.array([ids[a: a + n].tobytes() for a, n in zip(offsets.tolist(), sizes.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    schema = "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    needed = files.select(*[c.split()[0] for c in BLOCKS.split(", ")])
    return needed.mapInArrow(documents, schema).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def fetch(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids as 4-byte integers) of the asked documents that are there; of repeated ids the first."""
    wanted = np.unique(np.array(doc_ids, np.int64))
    near = F.exists(F.array(*[F.lit(int(k)) for k in wanted]).cast("array<bigint>"), lambda k: k.between(F.col("first"), F.col("last")))

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = wanted[(wanted >= row["first"]) & (wanted <= row["last"])]
                found, offsets, sizes = _looked_up(row, asked, np.zeros(len(asked), np.int64))
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                spans = zip(offsets[found].tolist(), sizes[found].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[found]), pa.array([ids[a: a + n].tobytes() for a, n in spans], pa.binary())], ["doc_id", "ids"])

    return files.where(near).mapInArrow(documents, "doc_id long, ids binary")
