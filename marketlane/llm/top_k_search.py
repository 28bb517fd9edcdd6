"""Exact top-k search by inner product over norm-sorted, rotated vectors.

The index holds the vectors by descending length, in range partitions. A rotation
(right singular vectors of a bounded sample) turns most of every length into the
first components. For a query and the k-th best score so far (its floor):

* |query| * |row| below the floor rules out the row and, as lengths descend, all
  that follow it: whole chunks, and by the index's statistics whole row groups;
* the partial product of the first rotated components, plus the product of what
  lengths are left (Cauchy-Schwarz), below the floor rules out a row part-way;
* what is left is scored exactly, in whole numbers.

The longest range partition is searched first; the floors it gives are valid for
all rows. Any rotation gives the same results; the sample only decides how early
rows are ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrays import release
from .best_rows import BestRows, pick_best
from .staging import PARTITION_BYTES, stage
from .vectors import CHUNK, TILE, in_blocks, matrix, query_blocks, shape, whole_vectors

SAMPLE_VALUES = 1 << 20     # components of the rows that the rotation is fitted on
STEPS = (0.25, 0.5, 0.75)   # shares of the rotated components after which rows are ruled out
SLACK = 1e-9                # of |query| * |row|: far above the rounding of rotated products

RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` rows of highest inner product: (query_id, rank, vec_id, score).

    Queries are the rows for which ``is_query`` holds; candidates are all rows of
    another id. Components become floor(scale * component). Ties go to the smaller
    id. Fewer candidates give fewer rows; an empty table gives none.

    Rows without a place here: see ``whole_vectors`` (null id, null vector, null or
    non-finite component, over-long vectors). Shorter vectors count as filled up with
    zeros; an empty vector is all zeros. Of rows that repeat an id, each is a candidate
    and, if it is a query, has an answer of its own. Other columns are left out."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, vectors[id], vectors[vector], is_query=F.coalesce(is_query, F.lit(False)))
    index, count, width = build_index(rows)
    empty = spark.createDataFrame([], RESULT)
    if not count:
        return empty
    turned = rotation(index, width)
    queries = index.where("is_query").select("id", "values")

    def answer(block: pa.Table) -> DataFrame:
        held = Queries(block, turned)
        first = search(index.where("part = 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), held, held.floor, k)
        floors = np.full(len(held.id), -np.inf)
        for query, score in first.where(F.col("rank") == k).select("query", "score").toLocalIterator():
            floors[query] = score
        # No query of the block can gain a row that is shorter than this.
        reach = float(np.min(np.where(held.norm > 0, floors / np.maximum(held.norm, 1e-9), -np.inf)))
        least = max(0.0, reach) ** 2 * (1 - 4 * SLACK)
        found = search(index.where(F.col("norm2") >= least), held, floors, k)
        names = spark.createDataFrame(pa.table({"query": np.arange(len(held.id)), "query_id": held.id}))
        return found.join(F.broadcast(names), "query").select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))

    return in_blocks(query_blocks(queries, queries.count() * max(width, 1)), answer, "top-k", empty)


def build_index(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows by descending length, written in range partitions numbered by
    ``part``; with their number and width. Rows of one length are split by id."""
    count, width = shape(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * max(width, 1) * 8 // PARTITION_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("norm2").desc(), "id", F.xxhash64("values")).sortWithinPartitions(F.col("norm2").desc(), "id")
    return stage(ordered.withColumn("part", F.spark_partition_id()), "vectors-by-length"), count, width


def rotation(index: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors, as columns, of a sample of ``SAMPLE_VALUES`` components."""
    sample = index.orderBy(F.xxhash64("id", "values")).limit(max(1, SAMPLE_VALUES // max(width, 1)))
    values = matrix(sample.select("values").toArrow().column(0), width)
    return np.linalg.svd(np.linalg.qr(values, mode="r"), full_matrices=True)[2].T


class Queries:
    """A block of queries: ids, whole and rotated components, and the length that is
    left after each step. Broadcast; its size is bounded by ``BLOCK_VALUES``."""

    def __init__(self, block: pa.Table, turned: np.ndarray):
        self.turned, self.id = turned, block.column("id").to_numpy()
        self.whole = matrix(block.column("values"), len(turned))
        self.steps = sorted({max(1, round(s * len(turned))) for s in STEPS} - {len(turned)}) if len(turned) else []
        self.rotated, self.left, self.norm = self.turn(self.whole)
        self.floor = np.full(len(self.id), -np.inf)

    def turn(self, whole: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        rotated = whole @ self.turned
        squares = np.concatenate([np.zeros((len(whole), 1)), np.cumsum(rotated**2, axis=1)], axis=1)
        left = [np.sqrt(np.maximum(squares[:, -1] - squares[:, s], 0)) for s in self.steps]
        return rotated, left, np.sqrt((whole**2).sum(axis=1))


def search(index: DataFrame, held: Queries, floors: np.ndarray, k: int) -> DataFrame:
    """(query, rank, id, score double): each query's best ``k`` rows of ``index`` that reach its floor."""
    shared = index.sparkSession.sparkContext.broadcast((held, floors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = shared.value
        kept = BestRows(k, least, pa.int64())
        for batch in batches:
            ids, whole = batch.column(0).to_numpy(), matrix(batch.column(1), len(own.turned))
            by_length = np.argsort(-(whole**2).sum(axis=1), kind="stable")
            for first in range(0, len(ids), CHUNK):
                these = by_length[first:first + CHUNK]
                these = these[np.argsort(ids[these], kind="stable")]
                fold(own, kept, ids[these], whole[these], k)
        yield pa.RecordBatch.from_arrays([pa.array(kept.group), kept.id, pa.array(kept.score)], names=["query", "id", "score"])
        release()

    found = index.select("id", "values").mapInArrow(best, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def fold(own: Queries, kept: BestRows, ids: np.ndarray, whole: np.ndarray, k: int) -> None:
    """A chunk of rows, in the order of their ids, against all queries of the block."""
    rotated, left, norm = own.turn(whole)
    longest = norm.max()
    for first in range(0, len(own.id), TILE):
        tile = np.arange(first, min(first + TILE, len(own.id)))
        tile = tile[own.norm[tile] * longest * (1 + SLACK) >= kept.floor[tile]]
        if not len(tile):
            continue
        slack = SLACK * np.outer(own.norm[tile], norm)
        floor, partial, at, open_pairs = kept.floor[tile][:, None], 0.0, 0, None
        for step, rest, own_rest in zip(own.steps, left, own.left):
            partial = partial + own.rotated[tile, at:step] @ rotated[:, at:step].T
            at = step
            open_pairs = partial + np.outer(own_rest[tile], rest) + slack >= floor
            if open_pairs.mean() < 0.1:
                break
        scores = np.full((len(tile), len(ids)), -np.inf)
        if open_pairs is None or open_pairs.mean() >= 0.1:
            scores = own.whole[tile] @ whole.T
        else:
            row, column = np.nonzero(open_pairs)
            scores[row, column] = np.einsum("ij,ij->i", own.whole[tile[row]], whole[column])
        row, column = pick_best(scores, (scores >= floor) & np.isfinite(scores) & (own.id[tile][:, None] != ids[None, :]), k)
        kept.add(tile[row], scores[row, column], pa.array(ids[column]))
