"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. A negative for a positive
of score p is a row of another label with a score from ``ratio`` * p up to p, so the
windows of an anchor's positives overlap. Their upper limits, in descending order,
cut the scores into disjoint slots: slot i holds what is at most the i-th limit and
above the next one. A row is in one slot, and the window of positive i takes
from slots i, i + 1, ... down to its lower limit. Hence:

1. every task keeps the best ``k`` rows of each (anchor, slot); no row is held for
   several windows, and nothing is written for windows that share it;
2. the tasks' rows of a slot are merged to its best ``k``;
3. from the last slot upward, a suffix's best ``k`` are those of the slot and of the
   suffix below it; each window is its suffix's answer, cut at the lower limit.
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

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 5, percent: int = 80, scale: int = 256,
                   id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each anchor and positive the first ``k`` rows of another label with
    ``percent`` * positive_score <= 100 * negative_score <= 100 * positive_score:
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``is_anchor`` holds. An anchor's positives are
    its first ``positives`` rows of the same label and another id. Scores are inner
    products of floor(scale * component); higher ones come first, ties by smaller id.
    A positive of negative score has an empty window, one of score 0 takes rows of score 0.

    Rows without a place here: those of null ``label`` and those that ``whole_vectors``
    leaves out (null id, null vector, null or non-finite component, over-long
    vectors). Shorter vectors count as filled up with zeros. Of rows that repeat an id,
    each is a candidate, and each anchor has an answer of its own; a row is never a
    positive or negative of its own id. An anchor without positives, or a positive
    without negatives, gives no row, an empty table none. Labels are whole numbers.
    Other columns are left out."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors.where(label.isNotNull()), scale, vectors[id], vectors[vector],
                         label=label.cast("long"), is_anchor=F.coalesce(is_anchor, F.lit(False)))
    count, width = shape(rows)
    empty = spark.createDataFrame([], RESULT)
    if not count:
        return empty
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * max(width, 1) * 8 // PARTITION_BYTES))
    rows = stage(rows.repartition(parts), "labelled-vectors")
    anchors = rows.where("is_anchor").select("id", "label", "values")

    def answer(block: pa.Table) -> DataFrame:
        held = Anchors(block, width)
        goals = stage(best_rows(rows, held, None, positives).select("anchor", F.col("slot").alias("place"), "id", "score"), "positives")
        limits = np.full((len(held.id), positives), -np.inf)
        for anchor, place, score in goals.select("anchor", "place", "score").toLocalIterator():
            limits[anchor, place - 1] = score
        slots = best_rows(rows, held, (limits, percent), k)
        names = spark.createDataFrame(pa.table({"anchor": np.arange(len(held.id)), "anchor_id": held.id}))
        return suffix_merge(goals, slots, k, percent).join(F.broadcast(names), "anchor").select(*empty.columns)

    return in_blocks(query_blocks(anchors, anchors.count() * max(width, 1)), answer, "hard-negatives", empty)


class Anchors:
    """A block of anchors. Broadcast; its size is bounded by ``BLOCK_VALUES``."""

    def __init__(self, block: pa.Table, width: int):
        self.id, self.label = block.column("id").to_numpy(), block.column("label").to_numpy()
        self.whole = matrix(block.column("values"), width)


def best_rows(rows: DataFrame, held: Anchors, windows: tuple[np.ndarray, int] | None, k: int) -> DataFrame:
    """Without ``windows``: each anchor's best ``k`` rows of its label, with their rank as
    ``slot``. With the positives' limits: of each (anchor, slot) the best ``k`` rows of
    another label. (anchor, slot, id, score long); slots count from 1."""
    shared = rows.sparkSession.sparkContext.broadcast((held, windows))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = shared.value
        slots = 1 if cut is None else cut[0].shape[1]
        kept = BestRows(k, np.full(len(own.id) * slots, -np.inf), pa.int64())
        for batch in batches:
            ids, labels, whole = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), own.whole.shape[1])
            for first in range(0, len(ids), CHUNK):
                these = first + np.argsort(ids[first:first + CHUNK], kind="stable")
                fold(own, cut, kept, ids[these], labels[these], whole[these], k)
        group = kept.group
        yield pa.RecordBatch.from_arrays([pa.array(group // slots), pa.array((group % slots + 1).astype(np.int32)), kept.id, pa.array(kept.score.astype(np.int64))],
                                         names=["anchor", "slot", "id", "score"])
        release()

    found = rows.select("id", "label", "values").mapInArrow(best, "anchor long, slot int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.withColumn("slot", F.col("rank")).drop("rank") if windows is None else ranked.drop("rank")


def fold(own: Anchors, cut: tuple[np.ndarray, int] | None, kept: BestRows, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, k: int) -> None:
    """A chunk of rows, in the order of their ids, against all anchors of the block."""
    for first in range(0, len(own.id), TILE):
        tile = np.arange(first, min(first + TILE, len(own.id)))
        scores = own.whole[tile] @ whole.T
        same = own.label[tile][:, None] == labels[None, :]
        if cut is None:
            allowed = same & (own.id[tile][:, None] != ids[None, :]) & (scores >= kept.floor[tile][:, None])
            row, column = pick_best(scores, allowed, k)
            kept.add(tile[row], scores[row, column], pa.array(ids[column]))
            continue
        limits, percent = cut[0][tile], cut[1]
        slots = limits.shape[1]
        # Below the lowest lower limit no window takes anything.
        lowest = np.where(limits >= 0, limits, np.inf).min(axis=1) * percent
        open_pairs = ~same & (own.id[tile][:, None] != ids[None, :]) & (100 * scores >= lowest[:, None])
        for slot in range(slots):
            below = limits[:, slot + 1:slot + 2] if slot + 1 < slots else np.full((len(tile), 1), -np.inf)
            group = tile * slots + slot
            allowed = open_pairs & (scores <= limits[:, slot:slot + 1]) & (scores > below) & (scores >= kept.floor[group][:, None])
            row, column = pick_best(scores, allowed, k)
            kept.add(group[row], scores[row, column], pa.array(ids[column]))


def suffix_merge(goals: DataFrame, slots: DataFrame, k: int, percent: int) -> DataFrame:
    """Each positive's first ``k`` negatives, from its anchor's slots. A group has at
    most ``positives`` * ``k`` rows."""
    rows = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id")).alias("rows"))
    ends = goals.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id").alias("positive_id"), "score")), asc=False).alias("ends"))
    entry = "struct<down:bigint,id:bigint>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("best"), F.array().cast(f"array<struct<positive_id:bigint,score:bigint,best:array<{entry}>>>").alias("done"))

    def upward(state: Column, end: Column) -> Column:
        own = F.transform(F.filter("rows", lambda r: r["slot"] == end["place"]), lambda r: F.struct(r["down"].alias("down"), r["id"].alias("id")))
        best = F.slice(F.array_sort(F.concat(state["best"], own)), 1, k)
        cut = F.filter(best, lambda r: -100 * r["down"] >= percent * end["score"])
        window = F.struct(end["positive_id"].alias("positive_id"), end["score"].alias("score"), cut.alias("best"))
        return F.struct(best.alias("best"), F.concat(state["done"], F.array(window)).alias("done"))

    merged = ends.join(rows, "anchor").select("anchor", F.explode(F.aggregate("ends", start, upward)["done"]).alias("window"))
    placed = merged.select("anchor", "window.positive_id", F.col("window.score").alias("positive_score"), F.posexplode("window.best").alias("at", "row"))
    return placed.select("anchor", "positive_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("negative_id"), "positive_score", (-F.col("row.down")).alias("negative_score"))
