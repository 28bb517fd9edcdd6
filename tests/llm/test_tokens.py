"""Packing, token store and token counts against the tokenizers library."""

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marketlane.llm import arrays, bpe_pieces, packing, queries, token_counts, token_store

PATH = queries.tokenizer_path()
SF = "/root/testdata/sf0.001"


def library_ids(texts):
    return [e.ids for e in bpe_pieces.load_tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \t\n\r  　'stremvld a1é手😀²Ⅷ!?.́​\x1c\x85_<|>"))), max_size=6))
def test_encoder_gives_the_library_ids(texts):
    texts.append("x<|endoftext|> y's")
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    for _, data, offsets in arrays.slices(batch, "text"):
        ids, bounds = bpe_pieces.id_encoder(PATH).encode(data, offsets)
        assert [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))] == library_ids(texts)
        assert token_counts.MergeCounter(PATH).counts(data, offsets).tolist() == [len(x) for x in library_ids(texts)] if len(texts) == 1 else True


def test_encoder_keeps_its_ids_when_the_cache_overflows(monkeypatch):
    monkeypatch.setattr(bpe_pieces, "CACHE_PIECES", 40)
    encoder = bpe_pieces.IdEncoder(PATH)
    for step in range(6):
        texts = [" ".join(f"w{chr(97 + i * step % 26)}ord{i % (7 + step)}" for i in range(30)), "", " the same  words\u00a0 again", "don't"]
        batch = pa.record_batch({"text": pa.array(texts)})
        for _, data, offsets in arrays.slices(batch, "text"):
            ids, bounds = encoder.encode(data, offsets)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library_ids(texts)


def test_counts_on_edges(session, edge_docs, no_docs):
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(edge_docs, PATH).collect()}
    rows = edge_docs.collect()
    assert got == {(r.doc_id, len((r.text or "").encode()), n) for r, n in zip(rows, map(len, library_ids([r.text for r in rows])))}
    assert token_counts.token_counts(no_docs, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in lengths}
    plan = packing.best_fit_plan(counts, capacity)
    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bins += room == capacity
        if room > x:
            bisect.insort(rooms, room - x)
    used = {}
    key = list(zip(plan["length"], plan["rank"]))
    for x in set(lengths):
        for rank in range(counts[x]):
            e = bisect.bisect_right(key, (x, rank)) - 1
            q = rank - plan["rank"][e]
            used.setdefault(int(plan["bin"][e] + q // plan["per_bin"][e]), []).append((int(plan["used"][e] + (q % plan["per_bin"][e]) * x), x))
    assert len(used) == bins
    for placed in used.values():
        at = 0
        for offset, x in sorted(placed):
            assert offset == at
            at += x
        assert at <= capacity


def test_packing_whole_documents(session, edge_docs, no_docs):
    capacity = 512
    pieces = packing.token_pieces(edge_docs, PATH, capacity)
    ids = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        a = np.frombuffer(r.ids, np.uint32)
        assert len(a) == r.length <= capacity and (r.piece == 0 or r.length == capacity)
        ids.setdefault((r.doc_id, r.piece), []).append(a)
    assert len(ids[5, 0]) == 1 and sum(len(x) for (d, _), v in ids.items() if d == 5 for x in v) == len(library_ids([edge_docs.where("doc_id = 5").first().text])[0]) + 1
    packed = packing.best_fit_pack(pieces, capacity)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 4 * capacity
    assert packed.count() == pieces.count()
    assert packing.best_fit_pack(packing.token_pieces(no_docs, PATH, capacity), capacity).count() == 0
    odd = session.createDataFrame([(1, 3), (2, None), (3, 0), (4, 5)], "doc_id long, length long")
    assert {(r.doc_id, r.offset) for r in packing.best_fit_pack(odd, 8).collect()} == {(1, 5), (2, None), (3, None), (4, 0)}
    with pytest.raises(Exception):
        packing.best_fit_pack(odd, 4).collect()


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 32), st.integers(0, 9000), st.integers(0, 2**32 - 1), st.data())
def test_bit_packing_round_trip(bits, n, seed, data):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    shard = token_store.Shard(token_store.write_shard(ids, np.array([n]), bits))
    assert (shard.ids() == ids).all()
    a = data.draw(st.integers(0, n))
    b = data.draw(st.integers(a, n))
    assert (shard.ids(a, b) == ids[a:b]).all()


def test_store_round_trip(session, edge_docs, no_docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(edge_docs, path, PATH, shard_ids=1000)
    got = sorted(token_store.read_store(session, path).collect(), key=lambda r: r.start)
    want = sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, w, x in zip(got, want, library_ids([w.text for w in want]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (w.doc_id, at, len(x) + 1, np.array(x + [0], np.uint32).tobytes())
        at += r.n_tokens
    whole = np.concatenate([np.frombuffer(r.ids, np.uint32) for r in got])
    assert (token_store.read_tokens(session, path, 100, 5000) == whole[100:5000]).all()
    empty = str(tmp_path / "empty")
    token_store.write_store(no_docs, empty, PATH)
    assert token_store.read_store(session, empty).count() == 0


def test_queries(session):
    docs = {r.doc_id: r.text for r in session.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: np.array(x + [0], np.uint32) for k, x in zip(docs, library_ids(docs.values()))}
    q = queries.queries()
    assert {(r.doc_id, r.n_tokens, r.over_limit) for r in q["op6_token_counts"](session, SF).collect()} == {(k, len(x) - 1, len(x) - 1 > 1024) for k, x in ids.items()}
    at = 0
    for r in sorted(q["op4_token_store"](session, SF).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    pieces = q["op1_best_fit_packing"](session, SF).collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) for r in pieces)
    assert sum(r.length for r in pieces) == at
    assert q["op1_best_fit_packing"](session, SF).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_encoding_a_batch_holds_little_memory():
    """A Python worker encodes beside the executor's heap: what it holds does not grow with the batch."""
    import tracemalloc

    encoder = bpe_pieces.IdEncoder(PATH)
    batch = pa.record_batch({"text": pa.array([" ".join(f"w{i * k % 977} of {k}" for i in range(400)) for k in range(900)])})
    assert batch.nbytes > 2_500_000
    tracemalloc.start()
    for _, data, offsets in arrays.slices(batch, "text", packing.PIECE_SLICE):
        ids, bounds = encoder.encode(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000      # 43 MB with slices of 2 MB, 11 MB with those of 500 kB
