"""Exact passages of benchmark items in documents.

A window is ``window`` consecutive words of an item (all its words if it has
fewer). A document holds a window only where it holds the window's rarest
shingle, so a prefix of one shingle is enough: the shingles of the windows are
counted over all documents, each window is filed under its rarest one, and the
documents are joined on these alone. A hit must leave room for the window at
the position the shingle has in it (position and length bounds), match the hash
of all its words, and then match the words themselves.

Items are taken in blocks of bounded text size; a block's windows are broadcast,
and every document is read against every block. Rows are never paired up or
moved, so hot passages and copies cost what their text costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .arrays import ranges, release, shingle_hashes, slices, span_hashes, words
from .staging import pick

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4_000_000        # text of the items that one broadcast holds


@dataclass
class Windows:
    """The different windows of a block of items, filed by shingle.

    Arrays run over windows: number of words, hash of all words, the words
    themselves, the shingle size, and the items having the window.
    """
    size: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    width: np.ndarray
    items: list[list[int]]          # positions in item_ids
    item_ids: list
    shingles: list[np.ndarray]      # every shingle of each window, in order

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Sorted distinct shingles by shingle size."""
        return {int(w): np.unique(np.concatenate([s for s, k in zip(self.shingles, self.width) if k == w])) for w in np.unique(self.width)}


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words with one blank between."""
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts, ends))


def item_windows(ids: list, texts: list[str | None], window: int = WINDOW) -> Windows:
    """Windows of the given items; items without words have none."""
    found: dict[bytes, int] = {}
    out = Windows(np.zeros(0, np.int64), np.zeros(0, np.uint64), [], np.zeros(0, np.int64), [], ids, [])
    size, hashed, width = [], [], []
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    at = 0
    for _, data, offsets in slices(batch, "text"):
        low, starts, ends, first = words(data, offsets)
        h = span_hashes(low, starts, ends)
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            for s in range(a, max(b - window, a) + 1) if b > a else ():
                e = min(s + window, b)
                text = _joined(low, starts[s:e], ends[s:e])
                if text not in found:
                    found[text] = len(out.text)
                    k = min(SHINGLE, e - s)
                    out.text.append(text)
                    out.items.append([])
                    out.shingles.append(shingle_hashes(h[s:e], k))
                    size.append(e - s)
                    hashed.append(shingle_hashes(h[s:e], e - s)[0])
                    width.append(k)
                own = out.items[found[text]]
                if not own or own[-1] != at + i:
                    own.append(at + i)
        at += len(offsets) - 1
    out.size, out.hash, out.width = np.array(size, np.int64), np.array(hashed, np.uint64), np.array(width, np.int64)
    return out


class Filed:
    """Windows sorted by the shingle they are filed under, per shingle size."""

    def __init__(self, windows: Windows, counts: dict[tuple[int, int], int]):
        self.windows = replace(windows, shingles=[])       # no task needs them
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        rarest = [min(range(len(s)), key=lambda j: (counts.get((int(k), int(s[j])), 0), j)) for s, k in zip(windows.shingles, windows.width)]
        for k in np.unique(windows.width):
            number = np.flatnonzero(windows.width == k)
            place = np.array([rarest[i] for i in number], np.int64)
            key = np.array([windows.shingles[i][rarest[i]] for i in number], np.uint64)
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(key >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[int(k)] = (key[order], number[order], place[order], bits)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per row, and of every occurrence: row, first word in the row, window)."""
        low, starts, ends, first = words(data, offsets)
        h = span_hashes(low, starts, ends)
        n_words = np.diff(first)
        row_of = np.repeat(np.arange(len(n_words)), n_words)
        found = []
        w = self.windows
        for k, (key, number, place, bits) in self.by_width.items():
            s = shingle_hashes(h, k)
            at = np.flatnonzero(bits[(s >> np.uint64(44)).astype(np.int64)])
            low_i, high_i = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
            n = high_i - low_i
            entry = ranges(low_i, n)
            begin = np.repeat(at, n) - place[entry]
            window = number[entry]
            # Position and length: the whole window lies in one row.
            row = row_of[np.repeat(at, n)]
            fits = (begin >= first[row]) & (begin + w.size[window] <= first[row + 1])
            begin, window, row = begin[fits], window[fits], row[fits]
            for size in np.unique(w.size[window]):
                own = np.flatnonzero(w.size[window] == size)
                same = own[shingle_hashes_at(h, begin[own], int(size)) == w.hash[window[own]]]
                found += [(row[i], begin[i] - first[row[i]], window[i]) for i in same
                          if _joined(low, starts[begin[i]:begin[i] + size], ends[begin[i]:begin[i] + size]) == w.text[window[i]]]
        rows, begins, numbers = np.array(found, np.int64).reshape(-1, 3).T
        return n_words, rows, begins, numbers


def shingle_hashes_at(h: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """``shingle_hashes`` of the ``width`` entries from each position on."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    return shingle_hashes(h[begin[:, None] + np.arange(width)].reshape(-1), width)[::width]


def _blocks(items: DataFrame, block_bytes: int) -> list[int]:
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return list(range(max(1, math.ceil(total / block_bytes))))


def mark_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words LONG, spans ARRAY<STRUCT<start LONG, end LONG>>, item_ids ARRAY): per
    row of ``docs`` the joined word ranges inside occurrences of windows, ascending,
    and the different items having an occurring window, as strings, sorted.

    Null and wordless texts have no words and no hits; items without words have no
    windows, repeated items count once. Windows of items of null id have spans like any
    other, only ``item_ids`` cannot name them. An empty item table marks nothing.
    """
    marked = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("starts"),
        F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<string>").alias("item_ids"))
    for filed in _filed_blocks(docs, items, window, text, item_id, item_text, block_bytes):
        marked = _mark_block(marked, filed)
    return marked.select("doc_id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with its columns, that hold no window of any item."""
    for filed in _filed_blocks(docs, items, window, text, item_id, item_text, block_bytes):
        docs = _drop_block(docs, filed, text)
    return docs


def _filed_blocks(docs: DataFrame, items: DataFrame, window: int, text: str, item_id: str, item_text: str, block_bytes: int) -> Iterator[Broadcast]:
    """Broadcast windows of one block of items after the other, filed by their
    rarest shingle over all of ``docs``."""
    chosen = pick(items, item_id=item_id, text=item_text).withColumn("item_id", F.col("item_id").cast("string"))
    blocks = _blocks(chosen, block_bytes)
    for b in blocks:
        rows = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(len(blocks))) == b).orderBy("item_id").collect()   # about block_bytes
        windows = item_windows([r["item_id"] for r in rows], [r["text"] for r in rows], window)
        counts = _shingle_counts(pick(docs, text=text), windows) if windows.text else {}
        yield docs.sparkSession.sparkContext.broadcast(Filed(windows, counts))


def _drop_block(docs: DataFrame, filed: Broadcast, text: str) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                clean = np.ones(len(rows), bool)
                clean[filed.value.hits(data, offsets)[1]] = False
                yield rows.filter(pa.array(clean))
        release()

    return docs.mapInArrow(keep, docs.schema)


def _shingle_counts(texts: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """Occurrences of the windows' shingles, by (size, hash), over all texts."""
    wanted = texts.sparkSession.sparkContext.broadcast(windows.all_shingles())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = wanted.value
        total = {k: np.zeros(len(s) + 1, np.int64) for k, s in shingles.items()}
        flags = {}
        for k, s in shingles.items():
            flags[k] = np.zeros(1 << 20, bool)
            flags[k][(s >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                low, starts, ends, _ = words(data, offsets)
                h = span_hashes(low, starts, ends)
                for k, s in shingles.items():
                    own = shingle_hashes(h, k)
                    own = own[flags[k][(own >> np.uint64(44)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(s, own), len(s) - 1)
                    total[k] += np.bincount(np.where(s[at] == own, at, len(s)), minlength=len(s) + 1)
        for k, s in shingles.items():
            seen = np.flatnonzero(total[k][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(s[seen].view(np.int64)), pa.array(total[k][seen])], names=["width", "shingle", "n"])

    # One count per shingle of the block's items.
    counted = texts.mapInArrow(count, "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
    return {(r["width"], r["shingle"] & (2**64 - 1)): r["n"] for r in counted.collect()}


def _mark_block(marked: DataFrame, filed: Broadcast) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filed.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                n_words, row, begin, window = f.hits(data, offsets)
                before = {name: rows.column(rows.schema.get_field_index(name)) for name in ("starts", "ends", "item_ids")}
                starts, ends, items = ([x.as_py() for x in before[name]] for name in ("starts", "ends", "item_ids"))
                for i in np.unique(row):
                    own = row == i
                    a = np.concatenate([begin[own], np.array(starts[i], np.int64)])
                    e = np.concatenate([begin[own] + f.windows.size[window[own]], np.array(ends[i], np.int64)])
                    order = np.argsort(a, kind="stable")
                    a, e = a[order], np.maximum.accumulate(e[order])
                    new = np.append(True, a[1:] > e[:-1])
                    starts[i], ends[i] = a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    items[i] = sorted({f.windows.item_ids[j] for x in np.unique(window[own]) for j in f.windows.items[x] if f.windows.item_ids[j] is not None} | set(items[i]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n_words), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "starts", "ends", "item_ids"])

    return marked.mapInArrow(mark, marked.schema)
