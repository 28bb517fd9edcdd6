"""Best-fit decreasing packing of token sequences.

Best-fit decreasing depends on nothing but how many items have each length, and
a length is at most the capacity. So the items are counted per length (a
distributed aggregate), the packing is worked out once for the counts, for all
equal items of a step together, with a segment tree over remaining capacities,
and every item then looks up its own place by its rank among the items of its
length. The plan has at most a few entries per (length, remaining capacity): it
is bounded by the capacity squared, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from .arrays import binaries, ranges, release, slices
from .bpe_pieces import PIECE_SLICE, id_encoder
from .staging import pick, stage

END_ID = 0


class TightestOpen:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._any = [False] * (2 * self._size)

    def set(self, room: int, is_open: bool) -> None:
        i = self._size + room
        self._any[i] = is_open
        while i > 1:
            i //= 2
            self._any[i] = self._any[2 * i] or self._any[2 * i + 1]

    def first_from(self, room: int) -> int | None:
        """The smallest remaining capacity >= ``room`` with an open bin."""
        i = self._size + room
        while not self._any[i]:
            while i & 1:            # a right child: nothing more under this parent
                i //= 2
                if i == 0:
                    return None
            if i == 0:
                return None
            i += 1
        while i < self._size:
            i = 2 * i if self._any[2 * i] else 2 * i + 1
        return i - self._size


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing for ``counts[length]`` items of each length.

    An entry says: the items of ``length`` with ranks from ``rank`` on go, ``per_bin``
    to a bin, into the bins from ``bin`` on, behind the ``used`` tokens there.
    Bins of equal content history are one range (first bin, number of bins).
    """
    tree = TightestOpen(capacity)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    entries: list[tuple[int, int, int, int, int]] = []
    next_bin = 0

    def give_back(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            if len(open_bins[room]) == 1:
                tree.set(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"an item of length {length} does not fit a capacity of {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.first_from(length)
            if room is None:
                room = capacity
                first, n = next_bin, -(-left // (capacity // length))
                next_bin += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            # A bin that took an item is now the tightest that fits the next one,
            # so it is filled before another bin of the same room is touched.
            per_bin = room // length
            full = min(n, left // per_bin)
            rest = left - full * per_bin if full < n else 0
            rest = min(rest, per_bin - 1) if per_bin else 0
            entries.append((length, rank, first, per_bin, capacity - room))
            rank += full * per_bin + rest
            left -= full * per_bin + rest
            give_back(room - per_bin * length, first, full)
            if rest:
                give_back(room - rest * length, first + full, 1)
            give_back(room, first + full + bool(rest), n - full - bool(rest))
    columns = np.array(entries, np.int64).reshape(-1, 5)
    plan = dict(zip(("length", "rank", "bin", "per_bin", "used"), columns.T.copy()))
    order = np.lexsort((plan["rank"], plan["length"]))
    return {k: v[order] for k, v in plan.items()}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each item's rank among the task's items of its length."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        values, at, n = np.unique(length[order], return_index=True, return_counts=True)
        before = np.array([seen.get(int(v), 0) for v in values], np.int64)
        rank = np.empty(len(length), np.int64)
        rank[order] = ranges(before, n)
        seen.update({int(v): int(b + k) for v, b, k in zip(values, before, n)})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)],
                                         names=[*batch.schema.names, "part_no", "part_rank"])


def best_fit_pack(items: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (LONG): best-fit decreasing
    into sequences of ``capacity`` tokens, gapless from offset 0.

    Items of equal length are interchangeable and placed by input order. An
    item of null or no length needs no place and gets nulls; one longer than
    the capacity is an error (``token_pieces`` cuts long documents first). The
    columns of ``items`` are kept, but for any ``sequence_id`` and ``offset``, which
    the result replaces. An empty table gives an empty one.
    """
    spark = items.sparkSession
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # Under own names here, so that no name of the caller's clashes with one below.
    renamed = items.select(items[length].cast("long").alias("length"), *[items[c].alias(f"c{i}") for i, c in enumerate(names) if c != length])
    kept = renamed.columns
    schema = T.StructType([*renamed.schema.fields, T.StructField("part_no", T.IntegerType()), T.StructField("part_rank", T.LongType())])
    # Items are written before they are numbered: one Python worker at a time per task.
    numbered = stage(stage(renamed, "pack-input").mapInArrow(_numbered, schema), "pack-items")

    per_part = numbered.where("length > 0").groupBy("part_no", "length").agg(F.count(F.lit(1)).alias("n"))
    per_part = stage(per_part, "pack-counts")
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))

    earlier = Window.partitionBy("length").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part_no", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
    ranked = numbered.join(bases, ["part_no", "length"], "left").select(*kept, (F.col("rank_base") + F.col("part_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p["length"] << 44) | p["rank"]
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank"))
            none = rank.is_null().to_numpy(zero_copy_only=False)
            size = batch.column(batch.schema.get_field_index("length")).fill_null(0).to_numpy(zero_copy_only=False)
            r = rank.fill_null(0).to_numpy(zero_copy_only=False)
            if len(key):
                i = np.maximum(np.searchsorted(key, (size << 44) | r, side="right") - 1, 0)
                q = r - p["rank"][i]
                sequence = p["bin"][i] + q // p["per_bin"][i]
                offset = p["used"][i] + (q % p["per_bin"][i]) * size
            else:
                sequence = offset = np.zeros(len(r), np.int64)
            columns = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, mask=none), pa.array(offset, mask=none)],
                                             names=[*kept, "sequence_id", "offset"])

    out = T.StructType([*renamed.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.mapInArrow(place, out)
    return placed.select(*[F.col("length" if c == length else f"c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece INT, start LONG, length LONG, ids BINARY): each document's
    token ids and the end id, cut into pieces of ``capacity`` where longer (the
    first piece may be shorter). ``ids`` are little-endian unsigned 32-bit.

    A null text is empty: one piece holding the end id. Rows are independent, so
    repeated rows and null ids give pieces of their own.
    """
    chosen = pick(docs, doc_id=doc_id, text=text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", PIECE_SLICE):
                ids, bounds = encoder.encode(data, offsets)
                n = np.diff(bounds) + 1
                ends = np.cumsum(n)
                flat = np.full(int(ends[-1]), END_ID, np.uint32)
                flat[ranges(ends - n, n - 1)] = ids
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = ranges(np.zeros(len(n), np.int64), pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     binaries(flat, np.append((ends - n)[row] + start, ends[-1]))],
                    names=["doc_id", "piece", "start", "length", "ids"])
        release()

    schema = T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return chosen.mapInArrow(cut, schema)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids BINARY, n_tokens) of packed pieces that kept their ids.
    A group holds at most one capacity of tokens."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("offset"), F.col(ids).alias("ids"))))
    whole = packed.where("sequence_id is not null").groupBy("sequence_id").agg(ordered.alias("parts"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens")
