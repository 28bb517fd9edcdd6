"""Token ids in files of fixed-width bit packing.

A store is a Parquet folder of shards in token order. A shard's payload is
(little-endian): magic ``TKID``, version, bits per id, ids per block, ids, documents,
then the end of each document (in ids), the byte offset of each block, and the
blocks. Ids take the fewest bits that hold the vocabulary, lowest bit first; a
block starts at a byte, so a range of ids is read from its own blocks only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from .arrays import binaries, ranges, release, slices
from .bpe_pieces import PIECE_SLICE, id_encoder, load_tokenizer
from .staging import partitions_for, pick

MAGIC, VERSION = b"TKID", 1
HEADER = struct.Struct("<4sHHIQQ")
BLOCK_IDS = 4096
SHARD_IDS = 1_000_000
END_ID = 0
BROADCAST_PARTS = 1_000_000     # rows of 12 bytes; a task writes some 32 MB of text


def bits_for(vocabulary: int) -> int:
    """Fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as one run of ``bits``-wide numbers, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    table = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(table.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of a ``pack``ed run."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    padded = np.frombuffer(bytes(raw) + bytes(8), np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    value = np.zeros(n, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        value |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_shard(ids: np.ndarray, doc_ends: np.ndarray, bits: int) -> bytes:
    """One shard's payload."""
    blocks = [pack(ids[i:i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([HEADER.pack(MAGIC, VERSION, bits, BLOCK_IDS, len(ids), len(doc_ends)),
                     np.asarray(doc_ends).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a shard's payload."""

    def __init__(self, payload: bytes):
        magic, version, self.bits, self.block_ids, self.n_ids, n_docs = HEADER.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        self._raw = memoryview(payload)
        n_blocks = -(-self.n_ids // self.block_ids)
        at = HEADER.size
        self.doc_ends = np.frombuffer(self._raw, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.block_offsets = np.frombuffer(self._raw, "<u8", n_blocks + 1, at).astype(np.int64)
        self._data = at + 8 * (n_blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks they lie in are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        if self.bits in (8, 16, 32):        # whole bytes per id: the blocks follow without gaps
            run = unpack(self._raw[self._data + self.block_offsets[first]:self._data + self.block_offsets[last + 1]], self.bits,
                         min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids)
        else:
            run = np.concatenate([unpack(self._raw[self._data + self.block_offsets[b]:self._data + self.block_offsets[b + 1]], self.bits,
                                         min(self.n_ids - b * self.block_ids, self.block_ids)) for b in range(first, last + 1)])
        return run[start - first * self.block_ids:stop - first * self.block_ids]


def write_store(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes every document, appends the end id, and writes the ids in ascending
    ``doc_id`` order (nulls first; equal ids by a hash of their text) to ``path``.

    Texts are range-partitioned by id before encoding, and one task writes its
    range's shards in order. A shard ends after the document that fills it.
    """
    chosen = pick(docs, doc_id=doc_id, text=text)
    parts = partitions_for(chosen, "text")
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer)
        bits = bits_for(max(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True), END_ID + 1))
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, first, held
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            docs_of = pa.concat_arrays([x[0] for x in held])
            listed = pa.ListArray.from_arrays(pa.array([0, len(docs_of)], pa.int32()), docs_of)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
                                              pa.array([len(ids)], pa.int64()), listed, pa.array([write_shard(ids, ends, bits)], pa.binary())],
                                             names=["part", "shard", "first_token", "n_tokens", "doc_ids", "payload"])
            shard, first, held = shard + 1, first + len(ids), []
            return row

        for batch in batches:
            for rows, data, offsets in slices(batch, "text", PIECE_SLICE):
                ids, bounds = encoder.encode(data, offsets)
                n = np.diff(bounds) + 1
                ends = np.cumsum(n)
                flat = np.full(int(ends[-1]), END_ID, np.uint32)
                flat[ranges(ends - n, n - 1)] = ids
                at = 0
                while at < len(n):
                    room = shard_ids - sum(len(x[1]) for x in held)
                    begin = int(ends[at] - n[at])
                    stop = min(int(np.searchsorted(ends, begin + room, side="left")) + 1, len(n))
                    held.append((rows.column(0).slice(at, stop - at), flat[begin:ends[stop - 1]], n[at:stop]))
                    at = stop
                    if sum(len(x[1]) for x in held) >= shard_ids:
                        yield close()
        if held:
            yield close()
        release()

    id_type = chosen.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The store's shards with ``start``: the ids of all shards before."""
    shards = spark.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task, a manifest of the store.
    manifest = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The payloads stay where they are read, unless the manifest is too long to broadcast.
    manifest = F.broadcast(manifest) if shards.select("part").distinct().count() <= BROADCAST_PARTS else manifest
    return shards.join(manifest, "part").select("part", "shard", (F.col("base") + F.col("first_token")).alias("start"), "n_tokens", "doc_ids", "payload")


def read_store(spark, path: str) -> DataFrame:
    """(doc_id, start LONG, n_tokens LONG, ids BINARY) of every document of a
    store; ``ids`` are little-endian unsigned 32-bit and end with the end id."""
    shards = read_shards(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard(batch.column(5)[i].as_py())
                n = np.diff(shard.doc_ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(4).slice(i, 1).flatten(), pa.array(batch.column(2)[i].as_py() + shard.doc_ends - n), pa.array(n),
                     binaries(shard.ids(), np.append(0, shard.doc_ends))],
                    names=["doc_id", "start", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", shards.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return shards.mapInArrow(decode, schema)


def read_tokens(spark, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole store, for a reader that wants a
    window: only the shards it touches are fetched, only its blocks unpacked."""
    touched = read_shards(spark, path).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    rows = sorted(touched.select("start", "payload").collect(), key=lambda r: r["start"])
    return np.concatenate([np.zeros(0, np.uint32), *[Shard(bytes(r["payload"])).ids(max(0, start - r["start"]), stop - r["start"]) for r in rows]])
