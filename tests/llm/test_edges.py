"""Clashing names, null and empty keys, merged sketches, and the pipeline on edge tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlane.llm import fingerprints, near_dedup, packing, sharding, toxicity

from test_native_operators import brute_sketch

SF = "/root/testdata/sf0.001"


def test_keep_one_of_null_and_empty_ids_and_texts(session):
    rows = [(None, "one two three four five six", 1), ("", "one two three four five six", 2), ("a", None, 3), ("a", "", 4), ("b", "x", 5), ("b", "x", 6), ("c", "x", 7)]
    docs = session.createDataFrame(rows, "doc_id string, text string, key int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == [("", "one two three four five six"), ("a", ""), ("b", "x")]
    assert all(tuple(r) in rows for r in kept.collect())           # whole rows, not mixed ones
    alone = near_dedup.keep_one(docs.where("doc_id is null")).collect()
    assert [tuple(r) for r in alone] == rows[:1]


def test_merge_is_the_sketch_of_both(session):
    rng = random.Random(3)
    pairs = []
    for _ in range(150):
        a, b = ([f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 200]))] for _ in range(2))
        pairs.append((" ".join(a), " ".join(b)))
    df = session.createDataFrame(pairs, "a string, b string")
    merged = df.select("a", "b", fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"))
    below = -(1 << 63) + (1 << 64) // fingerprints.SCALE
    for r in merged.collect():
        union = sorted({*brute_sketch(r.a), *brute_sketch(r.b)})
        assert r.m == ([h for h in union if h < below] or union[:1])


def test_clashing_columns(session, tmp_path):
    df = session.createDataFrame([(1, 5, "u", 7, "x"), (2, 5, "v", 8, "y"), (3, None, "w", 9, "z")], "sequence_id int, length int, part_no string, rank int, file string")
    packed = packing.best_fit_pack(df, 10)
    assert packed.columns == ["length", "part_no", "rank", "file", "sequence_id", "offset"]
    assert sorted((r.part_no, r.rank, r.offset is None) for r in packed.collect()) == [("u", 7, False), ("v", 8, False), ("w", 9, True)]
    sharding.write_shards(df.withColumn("file_", F.lit(1)), str(tmp_path / "s"), "rank", ["a"], files_per_shard=2)
    assert {r.file for r in session.read.parquet(str(tmp_path / "s")).collect()} == {"x", "y", "z"}
    docs = session.createDataFrame([(1, "good words here", 0.9)], "doc_id int, text string, score double")
    scored = toxicity.score_column(docs, toxicity.Weights())
    assert scored.columns == ["doc_id", "text", "score"] and scored.first().score == 0.5


@pytest.mark.parametrize("rows", [0, None])
def test_pipeline_stages_on_edge_tables(session, edge_docs, rows):
    """Null ids and texts, repeated rows, names that clash; and the same table without rows."""
    names = {"score": "toxicity", "key": "class_id", "label": "sequence_id", "bucket": "length"}
    docs = edge_docs.withColumnsRenamed(names)
    docs = docs if rows is None else docs.limit(rows)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(session, docs, SF)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0, name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](session, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert bool(packed) == (rows is None)
