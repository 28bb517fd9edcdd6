"""Whole Arrow text columns as byte arrays: words, word hashes, n-gram hashes.

Everything works on UTF-8 bytes with numpy, for many documents at once. A slice
of a batch holds about ``SLICE_BYTES`` of text (a longer document is a slice of
its own), so memory does not depend on the batch size Spark chose.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
U64 = np.uint64


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None


def release() -> None:
    """Hands freed memory back to the system. A Python worker lives on after its
    task, beside the executor's heap, and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64): spreads every input bit over the output."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = splitmix(np.arange(256, dtype=U64))
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Byte classes of the two word rules. Every byte of a non-ASCII character is
# above 0x7F, so a class of characters is a class of bytes.
ALNUM_BYTES = np.zeros(256, bool)      # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True
NON_BLANK_BYTES = np.ones(256, bool)   # [^\x20\x09-\x0D]
NON_BLANK_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the hash step and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) per slice of ``batch``; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first:last + 1]
        yield batch.slice(first, last - first), data[own[0]:own[-1]], own - own[0]
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of True bytes inside one row: starts, ends, and per row the
    index of its first run (one more entry at the end)."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    opens[inner] = mask[inner]
    closes[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial code."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODE[data] * up[:len(data)], out=total[1:])
    return splitmix((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, byte_class: np.ndarray = ALNUM_BYTES
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words: (lower-cased bytes, starts, ends, first word per row)."""
    low = LOWER[data]
    starts, ends, first = runs(byte_class[low], offsets)
    return low, starts, ends, first


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries (across rows too: the caller
    keeps those inside a row)."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    mixed = word_hash[:n].copy()
    for k in range(1, width):
        mixed = splitmix(mixed) + word_hash[k:k + n]
    return splitmix(mixed)


def row_shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all word shingles inside rows; a row of fewer words, but
    not none, has one shingle of all its words."""
    count = np.diff(first)
    at = ranges(first[:-1], np.maximum(count - width + 1, 0))
    hashed = shingle_hashes(word_hash, width)
    rows = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
    out = hashed[at] if len(hashed) else np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.empty(len(short), U64)
        for size in range(1, width):
            these = count[short] == size
            if these.any():
                extra[these] = shingle_hashes(word_hash, size)[first[:-1][short[these]]]
        out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)`` for each start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose rows are ``values[bounds[i]:bounds[i+1]]`` as bytes."""
    values = np.ascontiguousarray(values)
    at = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])
