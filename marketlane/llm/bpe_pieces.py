"""Byte-level BPE pieces of whole text columns, and their token ids.

A byte-level BPE tokenizer first cuts a text into pieces (a word with its
leading blank, a number, punctuation, white space) and then merges inside each
piece only. ``cut`` finds the same pieces as the library for many texts at once
with numpy; ``IdEncoder`` asks the library once per distinct piece and puts the
ids of the texts together from a bounded cache. A tokenizer of another kind is
simply applied to whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import ranges

PIECE_SLICE = 500_000      # bytes of text cut at a time: repeated pieces are looked up once
CACHE_PIECES = 100_000    # distinct pieces kept per Python worker, some 3 MB; then those of the last slice only
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
PIECES_A_CALL = 10_000    # new pieces given to the library at once
# First bytes, after the blank, of a piece that may be white space: ASCII blanks, and what leads the other blanks.
MAYBE_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"))
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")   # fixed by the byte-level pre-tokenizer

_loaded: dict = {}


def load_tokenizer(path: str):
    """The tokenizer file, loaded once per worker. A task has one core, so the
    library's own threads stay off unless the environment asks for them."""
    if ("tokenizer", path) not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _loaded["tokenizer", path] = Tokenizer.from_file(path)
        _loaded["tokenizer", path].no_padding()
        _loaded["tokenizer", path].no_truncation()
    return _loaded["tokenizer", path]


class PieceCutter:
    """Cuts UTF-8 texts into the pieces of a byte-level pre-tokenizer. The class
    of a character (letter, number, blank, other) is asked from the library when
    the character is first met."""

    def __init__(self, tokenizer):
        self._pre = tokenizer.pre_tokenizer
        self._class = np.full(0x110000, -1, np.int8)
        self._class[0xD800:0xE000] = OTHER
        self._resolve(np.arange(128))
        self._ascii = np.zeros(256, np.int8)
        self._ascii[:128] = self._class[:128]
        self._special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def fits(tokenizer) -> bool:
        """Whether the tokenizer cuts pieces by the byte-level rule alone."""
        import json
        spec = json.loads(tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True))
                and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
                and all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"]))

    def _pieces(self, text: str) -> int:
        return len(self._pre.pre_tokenize_str(text))

    def _resolve(self, codes: np.ndarray) -> None:
        for code in codes:
            c = chr(code)
            if self._pieces(f"a{c}a") == 1:
                kind = LETTER
            elif self._pieces(f"1{c}1") == 1:
                kind = NUMBER
            elif self._pieces(f"!{c}!") == 1:
                kind = OTHER
            else:
                kind = BLANK
            self._class[code] = kind

    def classes(self, data: np.ndarray) -> np.ndarray:
        """Character class of every byte; a character's later bytes have its class."""
        kind = self._ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = data[lead].astype(np.int32)
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            code = b & (0xFF >> (size + 1))
            for k in (1, 2, 3):
                more = size > k
                code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
            unknown = np.unique(code[self._class[code] < 0])
            self._resolve(unknown)
            own = self._class[code]
            kind[lead] = own
            for k in (1, 2, 3):
                more = size > k
                kind[lead[more] + k] = own[more]
        return kind

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of every piece; pieces cover all bytes and stay inside a row."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes(data)
        row_start = np.zeros(n + 1, bool)
        row_start[offsets] = True
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start |= row_start
        at = np.flatnonzero(start)
        left, right = at[:-1], at[1:]
        run_kind = kind[left]
        # A blank run before a non-blank one gives up its last character: a space
        # joins the next piece, another blank is a piece of its own.
        gives = (run_kind == BLANK) & ~row_start[right]
        ends = right[gives]
        last = ends - 1
        for _ in range(3):
            inside = (data[last] & 0xC0) == 0x80
            if not inside.any():
                break
            last = last - inside
        start[last] = True
        joins = data[last] == 0x20
        start[ends[joins]] = False
        # A lone apostrophe that no space joined takes a contraction's letters.
        lone = np.flatnonzero((run_kind == OTHER) & (right - left == 1) & (data[left] == 0x27) & ~row_start[right])
        lone = lone[start[left[lone]] & (run_kind[np.minimum(lone + 1, len(run_kind) - 1)] == LETTER)]
        for i in lone:
            begin, end = right[i], right[i + 1]
            letters = bytes(data[begin:min(end, begin + 2)])
            for c in CONTRACTIONS:
                if letters.startswith(c):
                    start[begin] = False
                    start[begin + len(c)] = True
                    break
        return np.flatnonzero(start[:n])

    def rows_with_special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose text holds the string of a special token."""
        raw, rows = data.tobytes(), set()
        for token in self._special:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    rows.add(row)
                at = raw.find(token, at + 1)
        return np.array(sorted(rows), np.int64)


def distinct_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Index of each piece among the distinct ones, and these."""
    bounds = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _bytes_of(pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces one after the other, and where each starts and the last ends."""
    bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


class IdEncoder:
    """Token ids of text columns, as ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.cutter = PieceCutter(self.tokenizer) if PieceCutter.fits(self.tokenizer) else None
        # Pieces met so far, how many ids each has, and these ids one after the other.
        self._known, self._size, self._known_ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if self.cutter is not None:     # bytes of each token: a byte-level token has one character per byte
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self._token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self._token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row's ids)."""
        n = len(offsets) - 1
        text = lambda i: data[offsets[i]:offsets[i + 1]].tobytes().decode()
        if self.cutter is None:
            parts = self._whole([text(i) for i in range(n)])
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            return np.concatenate([*parts, np.zeros(0, np.uint32)]), bounds
        starts = self.cutter.cut(data, offsets)
        if len(starts):
            index, pieces = distinct_pieces(data, starts)
            index = self._places(pieces)[index]
        else:
            index = np.zeros(0, np.int64)
        begin = np.cumsum(self._size) - self._size
        counts = self._size[index]
        flat = self._known_ids[ranges(begin[index], counts)]
        total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        bounds = total[np.searchsorted(starts, offsets)]
        special = self.cutter.rows_with_special(data, offsets)
        if len(special):
            whole = dict(zip(special.tolist(), self._whole([text(i) for i in special])))
            parts = [whole.get(i, flat[bounds[i]:bounds[i + 1]]) for i in range(n)]
            flat = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return flat, bounds

    def _places(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Where each of the distinct ``pieces`` is among the known ones; those not yet known are learnt."""
        place = pc.fill_null(pc.index_in(pieces, value_set=self._known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self._known) + int((place < 0).sum()) > CACHE_PIECES:      # keep what is met here only
            held = np.flatnonzero(place >= 0)
            begin = np.cumsum(self._size) - self._size
            ids = self._known_ids[ranges(begin[place[held]], self._size[place[held]])]
            self._known, self._size, self._known_ids = pieces.take(pa.array(held)), self._size[place[held]], ids
            place[held] = np.arange(len(held))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self._known) + self._learn(pieces.take(pa.array(new)))
        return place

    def _learn(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Adds ``pieces`` to the known ones; their order among the added ones."""
        data, bounds = _bytes_of(pieces)
        first = data[bounds[:-1]]
        second = np.where(np.diff(bounds) > 1, data[np.minimum(bounds[:-1] + 1, len(data) - 1)], 0x20)
        # A piece that starts with a blank and goes on with another character
        # is cut off the same way behind any other such piece.
        joins = (first == 0x20) & ~MAYBE_BLANK[second]
        parts, order = [], []
        for rows, ask in ((np.flatnonzero(joins), self._joined), (np.flatnonzero(~joins), self._each)):
            for i in range(0, len(rows), PIECES_A_CALL):
                order.append(rows[i:i + PIECES_A_CALL])
                some = pieces.take(pa.array(order[-1]))
                parts.append((some, *(ask(some) or self._each(some))))
        self._known = pa.concat_arrays([self._known, *[p[0] for p in parts]])
        self._size = np.concatenate([self._size, *[p[1] for p in parts]])
        self._known_ids = np.concatenate([self._known_ids, *[p[2] for p in parts]])
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(order)] = np.arange(len(pieces))
        return place

    def _each(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids), asking for each piece by itself."""
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces.to_pylist()], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        return np.array([len(i) for i in ids], np.int64), np.array([x for i in ids for x in i], np.uint32)

    def _joined(self, pieces: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for pieces that stay apart in one text: its ids are shared out
        by their lengths in bytes. None where these do not add up."""
        data, bounds = _bytes_of(pieces)
        text = data.tobytes()
        if any(token in text for token in self.cutter._special):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        if not len(ids) or ids.max() >= len(self._token_bytes):
            return None
        ends = np.cumsum(self._token_bytes[ids])
        last = np.minimum(np.searchsorted(ends, bounds[1:]), len(ends) - 1)
        if ends[-1] != bounds[-1] or (ends[last] != bounds[1:]).any():
            return None
        return np.diff(last, prepend=-1), ids


def id_encoder(path: str) -> IdEncoder:
    """One encoder (and cache) per worker and tokenizer file."""
    if ("encoder", path) not in _loaded:
        _loaded["encoder", path] = IdEncoder(path)
    return _loaded["encoder", path]
