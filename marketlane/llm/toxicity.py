"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams.

Features of a document are the distinct hashed words, word pairs and pairs with
one or two words skipped. Training takes a bounded sample of labelled documents:
their features are made in parallel, and one task runs FTRL-proximal (a learning
rate per coordinate, L1 sparsity) over them. What is left is a short sorted list
of non-zero weights, at most one per hash bucket, which is broadcast; every
document is then scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .arrays import release, slices, span_hashes, splitmix, words
from .staging import fresh, pick, stage

BITS = 20
MAX_TRAINING_ROWS = 12_000      # labelled documents used for training, the first by a hash of their id
PASSES = 6
LEAST_DOCUMENTS = 4             # features of fewer training documents are not learnt


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the FTRL-proximal update."""
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1


@dataclass
class Weights:
    """Non-zero weights by ascending feature, and the bias."""
    bias: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))


def feature_table(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once, ordered by both: hashed words, pairs of
    neighbours, and pairs with one and two words between. ``wanted`` (a flag per
    feature) leaves out the others."""
    low, starts, ends, first = words(data, offsets)
    hashed = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = []
    for gap in range(4):
        h, r = hashed, row
        if gap:
            same = row[gap:] == row[:-gap]
            h = splitmix(hashed[:-gap] + np.uint64(gap)) ^ hashed[gap:]
            h, r = splitmix(h[same]), row[gap:][same]
        f = (h >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[f]
            f, r = f[keep], r[keep]
        pairs.append((r << BITS) | f)
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def train_part(rows: list[tuple[np.ndarray, int]], parameters: Ftrl, passes: int = PASSES) -> Weights:
    """FTRL-proximal over (features, label) pairs, in the given order, several times."""
    p = parameters
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)      # the last coordinate is the bias, free of L1
    bias = 1 << BITS

    def solve(i: np.ndarray) -> np.ndarray:
        limit = np.where(i == bias, 0.0, p.l1)
        w = -(z[i] - np.sign(z[i]) * limit) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(z[i]) <= limit, 0.0, w)

    for _ in range(passes):
        for features, label in rows:
            i = np.append(features, bias)
            w = solve(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - step * w
            n[i] += g * g
    w = solve(np.arange(bias + 1))
    kept = np.flatnonzero(w[:bias])
    return Weights(float(w[bias]), kept, w[kept])


def train(docs: DataFrame, labels: DataFrame, label: str, usable, doc_id: str = "doc_id", text: str = "text",
          max_rows: int = MAX_TRAINING_ROWS, parameters: Ftrl = Ftrl()) -> Weights:
    """Weights learnt from at most ``max_rows`` of the labelled documents for which
    ``usable`` (a condition on ``doc_id``) holds. Labels other than 0 and 1, null ids and
    ids labelled both ways are left out; without any label all scores are 0.5."""
    known = pick(labels, doc_id=doc_id, label=label).where(usable & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other")).where("label = other")
    # The sample is of documents, so that a label without one takes no place.
    ids = pick(docs, doc_id=doc_id)
    sample = known.join(ids, "doc_id", "left_semi").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = stage(sample, "toxicity-sample")                # at most max_rows pairs of numbers
    chosen = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(sample), "doc_id")
    # Repeated rows of an id are trained on once.
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                row, feature = feature_table(data, offsets)
                at = np.searchsorted(row, np.arange(len(offsets)))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), lists], names=["doc_id", "label", "feature"])
        release()

    id_type = chosen.schema["doc_id"].dataType
    featured = chosen.mapInArrow(features, T.StructType([T.StructField("doc_id", id_type), T.StructField("label", T.IntegerType()), T.StructField("feature", T.ArrayType(T.IntegerType()))]))

    def run(table: pa.Table) -> pa.Table:
        by_id = np.argsort(table.column("doc_id").to_numpy())
        label = table.column("label").to_numpy()[by_id]
        feature = table.column("feature").combine_chunks()
        at, flat = feature.offsets.to_numpy(), feature.values.to_numpy()
        documents = np.bincount(flat, minlength=1 << BITS)            # a document has a feature once
        common = documents >= LEAST_DOCUMENTS
        lists = [flat[at[i]:at[i + 1]] for i in by_id]
        rows = [(x[common[x]], y) for x, y in zip(lists, label)]
        del table, feature, flat, lists
        order = np.random.default_rng(0).permutation(len(rows))
        w = train_part([rows[i] for i in order], parameters)
        del rows
        release()
        return pa.table({"bias": [w.bias], "feature": pa.array([w.feature], pa.list_(pa.int64())), "weight": pa.array([w.weight], pa.list_(pa.float64()))})

    # One group on purpose: the sample is bounded by max_rows.
    trained = featured.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "bias double, feature array<long>, weight array<double>").collect()
    if not trained:
        return Weights()
    return Weights(trained[0]["bias"], np.array(trained[0]["feature"], np.int64), np.array(trained[0]["weight"]))


def score_column(docs: DataFrame, weights: Weights, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with its score DOUBLE in [0, 1] as ``column``, for every row, empty and
    null texts included. All columns of ``docs`` are kept, but for one named ``column``, which the result replaces."""
    docs = docs.select([c for c in docs.columns if c != column])
    shared = docs.sparkSession.sparkContext.broadcast(weights)       # at most 2^BITS pairs

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        dense, wanted = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        dense[w.feature], wanted[w.feature] = w.weight, True
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                row, feature = feature_table(data, offsets, wanted)
                total = w.bias + np.bincount(row, dense[feature], minlength=len(rows))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*rows.schema.names, column])
        release()

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def drop_toxic(docs: DataFrame, weights: Weights, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with its columns, that score below ``threshold``."""
    column = fresh("toxicity", docs.columns)
    return score_column(docs, weights, text, column).where(F.col(column) < threshold).drop(column)
