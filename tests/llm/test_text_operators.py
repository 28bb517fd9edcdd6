"""Language model, decontamination, toxicity and near-dedup against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlane.llm import decontamination, lm_scoring, near_dedup, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_scores(texts, train, order):
    """(n_tokens, n_known, N, base, score) per text: a plain automaton, walked word by word."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</s>"] for t in texts]
    grams = collections.Counter()
    for words, known in zip(tokens, train):
        stream = ("<s>", *words)
        for i in range(len(stream)) if known else ():
            grams.update(stream[i - m + 1:i + 1] for m in range(1, order + 1) if i - m + 1 >= 0)
    uni = {g[0]: n for g, n in grams.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(x == k for x in uni.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))

    def arc(state, word):
        if not state:
            return 1 if not n else (uni[word] - discount if word in uni else discount * v) / n
        kinds = grams[state] ** lm_scoring.HEAPS
        return (grams[(*state, word)] + kinds * arc(state[1:], word)) / (grams[state] + kinds)

    def walk(words):
        state, weight = ("<s>",) if order > 1 and grams[("<s>",)] else (), 0.0
        for word in words:
            while state and not grams[(*state, word)]:
                kinds = grams[state] ** lm_scoring.HEAPS
                weight, state = weight + math.log10(kinds / (grams[state] + kinds)), state[1:]
            weight += math.log10(arc(state, word))
            state = (*state, word)[-(order - 1):] if order > 1 else ()
            while state and not grams[state]:
                state = state[1:]
        return weight

    return [(len(w), sum(x in uni for x in w), n, sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w), walk(w)) for w in tokens]


@pytest.mark.parametrize("order", [3, 1, 4])
def test_language_model(session, edge_docs, no_docs, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)      # several chunks
    docs = edge_docs.unionByName(session.read.parquet(f"{SF}/documents.parquet").select(
        (F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("").alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("label"), F.lit("").alias("bucket")))
    rows = docs.collect()
    train = [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    condition = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = collections.defaultdict(list)
    for r in lm_scoring.score(docs, condition, order=order).collect():
        got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    want = collections.defaultdict(list)
    for r, x in zip(rows, brute_scores([r.text for r in rows], train, order)):
        want[r.doc_id].append(x)
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a == pytest.approx(b, rel=1e-6)
    assert lm_scoring.score(no_docs, F.lit(True)).count() == 0
    assert lm_scoring.score(edge_docs, F.lit(False)).agg(F.max("score"), F.min("score")).first() == (0.0, 0.0)


def test_language_model_driver_rows(session, monkeypatch):
    docs = session.read.parquet(f"{SF}/documents.parquet").limit(40)
    want = sorted(tuple(r) for r in lm_scoring.score(docs, F.lit(True)).collect())
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(collect(df)) or collected[-1])
    scored = lm_scoring.score(docs, F.lit(True))
    monkeypatch.setattr(type(docs), "collect", collect)
    assert lm_scoring.partitions_for(docs, "text", 4000) > 8 and all(len(rows) <= 1 for rows in collected)
    for a, b in zip(sorted(tuple(r) for r in scored.collect()), want, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_language_model_after_known_and_unknown_contexts(session):
    training = ["a b c a b d", "a b c", "b c", "c"]
    known = ["a", "b", "c", "d"]
    probes = [f"{head} {word}" for head in ("", "a", "a b", "b c", "z", "a z", "c c") for word in [*known, "new"]] + ["", "a", "a b", "b c", "z", "a z", "c c"]
    docs = session.createDataFrame([(i, t) for i, t in enumerate(training + probes)], "doc_id int, text string")
    train = F.col("doc_id") < len(training)
    score = {r.doc_id: 10 ** r.score for r in lm_scoring.score(docs, train).collect()}
    of = {t: score[len(training) + i] for i, t in enumerate(probes)}
    brute = dict(zip(probes, (10 ** x[4] for x in brute_scores(training + probes, [True] * len(training) + [False] * len(probes), 3)[len(training):])))
    assert of == pytest.approx(brute)


def test_decontamination(session, edge_docs, no_docs):
    items = session.createDataFrame([(1, "beta GAMMA, delta"), (2, "theta"), (3, None), (4, "!!"), (10, " ".join(f"w{i % 97}x{i % 89}" for i in range(40, 75))),
                                     (10, "one"), (None, "one"), (11, "not in any of them")], "item_id long, text string")
    for block in (16_000_000, 60):
        got = sorted(decontamination.mark_passages(edge_docs, items, block_bytes=block).collect(), key=str)
        texts = {str(sorted(x)): x for x in []}
        windows = collections.defaultdict(set)
        for r in items.where("item_id is not null").collect():
            w = WORD.findall(lower(r.text))
            for i in range(max(1, len(w) - 9)) if w else ():
                windows[tuple(w[i:i + 10])].add(str(r.item_id))
        want = []
        for r in edge_docs.collect():
            w, hit, found = WORD.findall(lower(r.text)), set(), set()
            for size in {len(k) for k in windows}:
                for i in range(len(w) - size + 1):
                    if own := windows.get(tuple(w[i:i + size])):
                        hit |= set(range(i, i + size))
                        found |= own
            want.append((str(r.doc_id), len(w), len(hit), sorted(found)))
        assert sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in got) == sorted(want), texts
        kept = decontamination.drop_contaminated(edge_docs, items, block_bytes=block)
        assert kept.columns == edge_docs.columns and kept.count() == sum(not x[2] for x in want)
    assert decontamination.mark_passages(no_docs, items).count() == 0
    assert decontamination.mark_passages(edge_docs, items.limit(0)).where("size(spans) > 0").count() == 0


def test_decontamination_by_items_without_id(session):
    docs = session.createDataFrame([(1, "x Alpha beta gamma y"), (2, "theta alpha beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    items = session.createDataFrame([(None, "alpha, beta gamma"), (7, "theta")], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.item_ids) for r in decontamination.mark_passages(docs, items).collect()}
    assert got == {1: ([(1, 4)], []), 2: ([(0, 4)], ["7"]), 3: ([], [])}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == [3]


def test_decontamination_query(session):
    got = queries.queries()["op5_decontamination"](session, SF).collect()
    assert len(got) == session.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.contaminated == (r.n_hit > 0) == (r.n_items > 0) for r in got)
    assert {r.items_sha256 for r in got if not r.n_items} == {hashlib.sha256(b"").hexdigest()}


def test_toxicity(session, edge_docs, no_docs):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60) + (["vile", "awful", "scum"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(1200)]
    docs = session.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), "toxic", F.col("doc_id") % 5 != 0)
    scored = toxicity.score_column(docs, weights).where("doc_id % 5 = 0").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in scored) >= 0.97 * len(scored)
    assert len(weights.feature) < 2000
    edges = toxicity.score_column(edge_docs, weights, column="toxicity")
    assert edges.count() == edge_docs.count() and edges.where("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    assert toxicity.drop_toxic(edge_docs, weights).columns == edge_docs.columns
    nothing = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").limit(0), "toxic", F.lit(True))
    assert {r.toxicity for r in toxicity.score_column(edge_docs, nothing, column="toxicity").collect()} == {0.5}
    assert toxicity.score_column(no_docs.drop("score"), weights).count() == 0


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ftrl_equals_a_plain_loop():
    """One coordinate at a time, from the published update."""
    rng = random.Random(8)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(0, 9))), np.int64), rng.randint(0, 1)) for _ in range(200)]
    p = toxicity.Ftrl()
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        limit = 0.0 if i == "bias" else p.l1
        if abs(z[i]) <= limit:
            return 0.0
        return -(z[i] - math.copysign(limit, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(3):
        for features, label in rows:
            held = {i: weight(i) for i in [*features.tolist(), "bias"]}
            gradient = 1 / (1 + math.exp(-sum(held.values()))) - label
            for i, w in held.items():
                rate = (math.sqrt(n[i] + gradient ** 2) - math.sqrt(n[i])) / p.alpha
                z[i] += gradient - rate * w
                n[i] += gradient ** 2
    want = {i: weight(i) for i in range(40) if weight(i)}
    got = toxicity.train_part(rows, p, passes=3)
    assert dict(zip(got.feature.tolist(), got.weight.tolist())) == pytest.approx(want) and got.bias == pytest.approx(weight("bias"))
    assert 0 < len(want) <= 40


def brute_classes(rows):
    """Smallest id of each row's class: equal texts, or Jaccard of 0.8 on 5-word shingles."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(r.text) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i].text or "") == (rows[j].text or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return [None if best[find(i)][0] else best[find(i)][1] for i in range(len(rows))]


def test_near_duplicates(session, edge_docs, no_docs):
    rng = random.Random(5)
    base = [f"t{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(60):                       # a family from light to heavy edits, some of them under the threshold
        copy = list(base)
        for _ in range(i // 6):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(copy), "k", 0.0, 1, "b"))
    docs = edge_docs.unionByName(session.createDataFrame(rows, edge_docs.schema))
    want = docs.collect()
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(r.doc_id), str(c)) for r, c in zip(want, brute_classes(want)))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(set(map(str, brute_classes(want))))
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_one_sided_repetition_meets_in_a_band():
    rng = random.Random(17)
    texts = []
    for _ in range(80):                       # set similarity of 0.8 to 0.85; a line of one text 100 times in it
        first = [f"t{rng.randrange(10**6)}" for _ in range(240)]
        second = list(first)
        for at in (50, 120, 190):
            second[at] = f"e{rng.randrange(10**6)}"
        texts.append((" ".join(first[:200] + first[200:] * 100), " ".join(second[:240] + [f"x{rng.randrange(10**6)}" for _ in range(12)])))
    assert all(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for a, b in texts)
    batch = pa.record_batch({"doc_id": list(range(160)), "key": [b""] * 160, "text": [t for pair in texts for t in pair]})
    signed = [s.as_py() for out in near_dedup._sign(iter([batch])) for s in out.column(3)]
    width = near_dedup.BAND_ROWS * 4
    bands = [{(i, s[i:i + width]) for i in range(0, len(s), width)} for s in signed]
    assert all(bands[i] & bands[i + 1] for i in range(0, 160, 2))


def test_near_duplicates_groups_are_bounded(session, monkeypatch):
    rng = random.Random(11)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(240):                      # mostly some 0.7 to 0.8 alike, so that most members of a bucket stay unlinked
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4, 4, 5])):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    want = docs.collect()
    limit, linked = 40_000, near_dedup._linked        # a fifth of the family's shingles

    def bounded(group):
        assert sum(map(len, group.column("shingles").to_pylist())) <= limit
        return linked(group)

    monkeypatch.setattr(near_dedup, "SPLIT_BYTES", limit)
    monkeypatch.setattr(near_dedup, "_linked", bounded)
    monkeypatch.setattr(near_dedup, "MEMBERS_OF_COMPONENT", 2)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((r.doc_id, c) for r, c in zip(want, brute_classes(want)))


def test_meetings_cover_all_pairs(session, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT_BYTES", 400)
    rows = [(1, bytes([i]), bytes([i % 9]), i % 4, 10 + i % 7) for i in range(120)]
    met = collections.defaultdict(list)
    for r in near_dedup._meetings(session.createDataFrame(rows, "bucket long, key binary, label binary, kind int, size long")).collect():
        met[tuple(r.blocks)].append((r.key[0], r.side))
    pairs = collections.Counter()
    for group in met.values():
        pairs.update((min(x, y), max(x, y)) for x, s in group for y, t in group if (s == t == 0 and x < y) or (s == -1 and t == 1))
    want = {(x, y) for x in range(120) for y in range(x + 1, 120) if tuple(sorted((x % 4, y % 4))) in near_dedup.MEETINGS}
    assert set(pairs) == want and set(pairs.values()) == {1}


def test_pipeline_against_brute_force(session):
    docs = session.read.parquet(f"{SF}/documents.parquet").cache()
    weights = queries.toxicity_weights(docs, SF)
    left = [r for r in toxicity.score_column(docs, weights).collect() if r.score < 0.5]
    left = [r for r, c in zip(left, brute_classes(left)) if r.doc_id == c]
    windows = set()
    for r in session.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}

    def clean(text):
        w = WORD.findall(lower(text))
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    left = {r.doc_id for r in left if clean(r.text)}
    packed = corpus_pipeline.run(session, SF).collect()
    assert {r.doc_id for r in packed} == left
    ends = collections.defaultdict(list)
    for r in packed:
        ends[r.sequence_id].append((r.offset, r.length))
    for placed in ends.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    docs.unpersist()
