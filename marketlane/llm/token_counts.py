"""Exact token counts without token ids.

Inside a piece, byte-pair merging keeps the symbols in a linked list and the
adjacent pairs in a heap by merge rank; the lowest pair is popped, merged, and
its new neighbours are pushed. The count is the number of bytes minus the merges.
Counts of distinct pieces are kept in a bounded cache per worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import release, slices
from .bpe_pieces import PIECE_SLICE, PieceCutter, distinct_pieces, load_tokenizer
from .staging import pick

CACHE_PIECES = 200_000

_counters: dict = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeCounter:
    """Counts the tokens of byte-level BPE pieces by heap merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = load_tokenizer(path)
        if not PieceCutter.fits(tokenizer):
            raise ValueError("token counts need a byte-level BPE tokenizer file")
        self.cutter = PieceCutter(tokenizer)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        symbols = byte_symbols()
        number = {s: b for s, b in symbols.items()}    # symbol string -> symbol number; bytes first
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = number.setdefault(left + right, len(number))
            self._merge[number[left], number[right]] = (rank, whole)
        self._cache: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        """Symbols left after all merges."""
        n, merge = len(piece), self._merge
        if n < 2:
            return n
        symbol, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := merge.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue                     # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge.get((whole, symbol[k])):
                    heapq.heappush(heap, (found[0], i, whole, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merge.get((symbol[h], whole))):
                heapq.heappush(heap, (found[0], h, symbol[h], whole, found[1]))
        return n - merges

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        starts = self.cutter.cut(data, offsets)
        out = np.zeros(len(offsets) - 1, np.int64)
        if len(starts):
            index, pieces = distinct_pieces(data, starts)
            cache = self._cache
            if len(cache) > CACHE_PIECES:
                cache.clear()
            own = np.empty(len(pieces), np.int64)
            for i, piece in enumerate(pieces.to_pylist()):
                n = cache.get(piece)
                if n is None:
                    n = self.count(piece)
                    if len(piece) <= 64:
                        cache[piece] = n
                own[i] = n
            total = np.concatenate([[0], np.cumsum(own[index])])
            out = np.diff(total[np.searchsorted(starts, offsets)])
        for row in self.cutter.rows_with_special(data, offsets):
            out[row] = self._with_special(data[offsets[row]:offsets[row + 1]].tobytes())
        return out

    def _with_special(self, text: bytes) -> int:
        """A special token's string is one token; what lies between is counted by itself."""
        total, at = 0, 0
        while at < len(text):
            found = min(((p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0), default=None)
            end = found[0] if found else len(text)
            if end > at:
                part = np.frombuffer(text[at:end], np.uint8)
                starts = np.append(self.cutter.cut(part, np.array([0, len(part)])), len(part))
                total += sum(self.count(text[at + a:at + b]) for a, b in zip(starts[:-1], starts[1:]))
            total += found is not None
            at = end + (len(found[2]) if found else 0)
        return total


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes LONG, n_tokens LONG), one row per row of ``docs``; a null
    text is empty (0 tokens). No shuffle: each row is counted where it is read."""
    chosen = pick(docs, doc_id=doc_id, text=text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = MergeCounter(tokenizer)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", PIECE_SLICE):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(offsets)), pa.array(_counters[tokenizer].counts(data, offsets))],
                    names=["doc_id", "n_bytes", "n_tokens"])
        release()

    schema = T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return chosen.mapInArrow(count, schema)
