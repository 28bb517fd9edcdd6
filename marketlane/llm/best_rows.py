"""The k highest-scoring rows of each group, kept while rows stream by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class BestRows:
    """Of each group (numbered from 0) the ``k`` rows of highest score, ties to the
    smaller id, null ids last. Holds ``k`` rows a group at most, whatever comes by.

    ``floor`` has the score that a further row of the group must reach: the given
    one, or that of the k-th row so far."""

    def __init__(self, k: int, floor: np.ndarray, id_type: pa.DataType):
        self.k, self.floor = k, floor.copy()
        self.group, self.score = np.zeros(0, np.int64), np.zeros(0, floor.dtype)
        self.id = pa.array([], id_type)

    def add(self, group: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if not len(group):
            return
        group, score = np.concatenate([self.group, group]), np.concatenate([self.score, score])
        ids = pa.concat_arrays([self.id, ids])
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -score, group))
        group, score = group[order], score[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        keep = rank < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids.take(pa.array(order[keep]))
        last = rank[keep] == self.k - 1
        self.floor[self.group[last]] = np.maximum(self.floor[self.group[last]], self.score[last])


def pick_best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest allowed scores; of equal ones the
    first columns, so columns in the order of their ids settle ties by id."""
    count = allowed.sum(axis=1)
    few = (count > 0) & (count <= k)
    rows, columns = np.nonzero(allowed & few[:, None])
    many = np.flatnonzero(count > k)
    if len(many):
        order = np.argsort(np.where(allowed[many], -scores[many], np.inf), axis=1, kind="stable")[:, :k]
        rows, columns = np.concatenate([rows, np.repeat(many, k)]), np.concatenate([columns, order.ravel()])
    return rows, columns
