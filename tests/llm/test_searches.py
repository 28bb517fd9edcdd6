"""Ranked lexical search, exact top-k search and hard negatives against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlane.llm import hard_negatives, lexical_search, top_k_search, vectors
from marketlane.llm.best_rows import BestRows, pick_best

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lexical_brute(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms_of(text))]
    df, total = Counter(t for _, c, _ in held for t in c), sum(n for *_, n in held)
    weight = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        scored = []
        for i, count, n in held:
            m = 25 + 75 * n * len(held) // total
            score = sum(weight[t] * (10**9 * count[t] // (1000 * count[t] + 8 * m)) for t in terms_of(text) if t in count)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if none else i, -down) for rank, (down, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 24)
    monkeypatch.setattr(vectors.query_blocks, "__defaults__", (24,))


def random_docs(seed, rows):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "手机", "x_y", "A9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 20, 400])))) for i in range(rows)]
    docs += [(rows + i, docs[3][1]) for i in range(40)]                     # copies: ties beyond k
    docs += [(5, docs[5][1]), (None, docs[4][1]), (rows + 50, None), (rows + 51, "."), (rows + 52, "w1 " * 3000)]
    items = [(i % 7, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30])))) for i in range(20)] + [(None, "w3 w9"), (99, None), (98, "nowhere")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_lexical_search_equals_brute_force(session, small_blocks, seed):
    docs, items = random_docs(seed, 120)
    got = lexical_search.search(session.createDataFrame(docs, "doc_id long, text string").repartition(5), session.createDataFrame(items, "item_id int, text string"))
    assert found(got) == lexical_brute(docs, items)


def test_lexical_search_edges(session, edge_docs, no_docs):
    items = session.createDataFrame([(1, "Alpha w1x1 café 手机", 3)], "item_id int, text string, query int")
    pairs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = lexical_search.search(edge_docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == lexical_brute(pairs, [(1, "Alpha w1x1 café 手机")])
    assert found(lexical_search.search(no_docs, items)) == []
    assert found(lexical_search.search(edge_docs, items.limit(0))) == []
    named = edge_docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in lexical_search.search(named, items).collect()} <= {f"d{i}" for i in range(12)}


def test_sketch_bounds_are_never_too_low(session):
    docs, items = random_docs(3, 80)
    index = lexical_search.term_lists(session.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", True).toArrow()
    block = lexical_search.term_lists(session.createDataFrame(items, "doc_id long, text string"), "doc_id", "text", False).toArrow()
    own = lexical_search.Block(block, len(index), sum(index["n"].to_pylist()))
    own.weigh(np.ones(len(own.terms)))
    batch = index.combine_chunks().to_batches()[0]
    m = own.length_terms(batch.column("n").to_numpy())
    bounds = lexical_search.upper_bounds(own, batch.column("sketch"), m)
    (terms, first), (counts, _) = lexical_search.values_of(batch.column("terms"), np.uint64), lexical_search.values_of(batch.column("counts"), np.uint32)
    doc, query = (x.ravel() for x in np.indices(bounds.shape))
    exact = lexical_search.exact_scores(own, doc, query, m, terms, counts, first).reshape(bounds.shape)
    assert (bounds >= exact).all() and exact.any() and (bounds == exact).mean() > 0.5


def whole(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def vector_rows(seed, rows, width):
    """Uneven lengths, exact copies beyond k, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    values = (rng.normal(size=(rows, width)) * rng.exponential(size=(rows, 1))).astype(np.float32)
    values[rows // 2:rows // 2 + 30] = values[0]
    out = [(i, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(values)]
    out += [(0, [1.0] * width, 1), (7, [0.5] * width, None), (rows + 1, None, 1), (rows + 2, [None] * width, 1), (None, [1.0] * width, 1),
            (rows + 3, [math.nan] * width, 2), (rows + 4, [math.inf] * width, 2), (rows + 5, [1e30] * width, 0), (rows + 6, [], 0), (rows + 7, [1.0], 1), (10 * rows, [0.0] * width, 2)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, score string, id int, part int"


def vector_table(session, rows):
    return session.createDataFrame([(*r, "s", 1, 2) for r in rows], VECTORS).repartition(3)


def taking_part(rows):
    rows = [(i, whole(v), label) for i, v, label in rows if i is not None]
    return [(i, v, label) for i, v, label in rows if v is not None and product(v, v) < 2**48]


def top_k_brute(rows, every, k=5):
    rows, out = taking_part(rows), []
    for q, own, _ in rows:
        if q % every == 0:
            best = sorted((-product(own, v), i) for i, v, _ in rows if i != q)[:k]
            out += [(q, rank, i, -down) for rank, (down, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 3), (3, 1)])
def test_top_k_equals_brute_force(session, seed, width):
    rows = vector_rows(seed, 300, width)
    assert found(top_k_search.top_k(vector_table(session, rows), F.col("vec_id") % 10 == 0)) == top_k_brute(rows, 10)


def test_top_k_in_blocks(session, small_blocks):
    rows = vector_rows(4, 120, 4)
    assert found(top_k_search.top_k(vector_table(session, rows), F.col("vec_id") % 6 == 0)) == top_k_brute(rows, 6)


def test_top_k_edges(session):
    none = vector_table(session, vector_rows(1, 40, 2)).limit(0)
    assert found(top_k_search.top_k(none, F.col("vec_id") % 10 == 0)) == []
    one = vector_table(session, [(10, [1.0, 2.0], 0)])
    assert found(top_k_search.top_k(one, F.col("vec_id") % 10 == 0)) == []
    assert found(top_k_search.top_k(vector_table(session, [(10, [], 0), (11, [], 0)]), F.col("vec_id") % 10 == 0)) == [(10, 1, 11, 0)]
    assert found(top_k_search.top_k(vector_table(session, [(11, [1.0], 0)]), F.col("vec_id") % 10 == 0)) == []


def test_rotation_rules_out_most_rows():
    """Vectors near a plane: after the first rotated components few rows are left."""
    rng = np.random.default_rng(0)
    data = np.floor(256 * (rng.normal(size=(600, 2)) @ rng.normal(size=(2, 16)) + 0.01 * rng.normal(size=(600, 16))))
    turned = np.linalg.svd(np.linalg.qr(data, mode="r"), full_matrices=True)[2].T
    block = pa.table({"id": np.arange(600), "values": pa.array(list(data))})
    own = top_k_search.Queries(block, turned)
    assert np.allclose(turned @ turned.T, np.eye(16)) and own.left[0].max() < 0.05 * own.norm.max()


def hard_brute(rows, every, k=5, positives=5):
    rows, out = [r for r in taking_part(rows) if r[2] is not None], []
    for a, own, label in rows:
        if a % every:
            continue
        scored = sorted((-product(own, v), i, l == label) for i, v, l in rows if i != a)
        for down, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [(s, i) for s, i, same in scored if not same and -80 * down <= -100 * s <= -100 * down][:k]
            out += [(a, p, rank, i, -down, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,width", [(1, 8), (2, 3), (5, 1)])
def test_hard_negatives_equal_brute_force(session, seed, width):
    rows = vector_rows(seed, 300, width)
    got = hard_negatives.hard_negatives(vector_table(session, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    assert found(got) == hard_brute(rows, 10) and got.count()


def test_hard_negatives_in_blocks(session, small_blocks):
    rows = vector_rows(6, 120, 4)
    got = hard_negatives.hard_negatives(vector_table(session, rows), F.col("vec_id") % 6 == 0, F.col("label"))
    assert found(got) == hard_brute(rows, 6)


def test_hard_negatives_edges(session):
    table = vector_table(session, vector_rows(1, 40, 2))
    anchors, label = F.col("vec_id") % 10 == 0, F.col("label")
    assert found(hard_negatives.hard_negatives(table.limit(0), anchors, label)) == []
    assert found(hard_negatives.hard_negatives(table.withColumn("label", F.lit(None).cast("int")), anchors, label)) == []
    assert found(hard_negatives.hard_negatives(table.withColumn("label", F.lit(1)), anchors, label)) == []
    zero = vector_table(session, [(10, [0.0], 0), (11, [1.0], 0), (12, [5.0], 1)])
    assert found(hard_negatives.hard_negatives(zero, anchors, label)) == [(10, 11, 1, 12, 0, 0)]


def test_best_rows_ties_and_floor():
    kept = BestRows(2, np.zeros(2), pa.int64())
    kept.add(np.array([0, 0, 0, 1]), np.array([5.0, 5.0, 5.0, 1.0]), pa.array([9, None, 3, 4]))
    assert kept.id.to_pylist() == [3, 9, 4] and kept.floor.tolist() == [5.0, 0.0]
    kept.add(np.array([0, 1]), np.array([6.0, 7.0]), pa.array([99, 98]))
    assert list(zip(kept.group, kept.id.to_pylist())) == [(0, 99), (0, 3), (1, 98), (1, 4)] and kept.floor.tolist() == [5.0, 1.0]
    row, column = pick_best(np.array([[1.0, 3.0, 3.0, 3.0], [0.0, 1.0, 2.0, 3.0]]), np.array([[True] * 4, [True, False, False, True]]), 2)
    assert sorted(zip(row, column)) == [(0, 1), (0, 2), (1, 0), (1, 3)]
