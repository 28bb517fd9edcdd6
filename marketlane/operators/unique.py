"""Who holds a unique value when: changes to a unique column, one at a time.

Whether a change of key k to value v succeeds depends on all earlier changes: v
must be free, or held by k, at that moment. Blocks of changes are replayed from the
holders that they find when they begin (``replay.py``). A wrong guess seldom outlives
a block, as a value's holder is soon decided by changes of the block itself. A block
holds about ``BLOCK_ROWS`` changes and as many holders at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import cut_to_keys
from .replay import in_blocks, settle

BLOCK_ROWS = 50_000


def unique_conflicts(opening: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, conflict): whether each change's value was held by another key.

    ``changes``: seq (unique), k (the key, not null), v (the new value, null for
    none) and fk_ok (a change that fails elsewhere is judged but not made).
    ``opening``: v and k of the table before the batch, v not null.
    """
    rows, blocks = in_blocks(changes.select("seq", "k", "v", "fk_ok"), "seq", BLOCK_ROWS)
    wanted = rows.where("v is not null").select("block", "v").distinct()
    held = cut_to_keys(opening.select("v", "k"), wanted, ["v"]).groupBy("v").agg(F.min("k").alias("holder"))
    if blocks > 1:
        wanted, held = materialize(wanted), materialize(held)
    state = wanted.join(held, "v").select("block", "v", "holder")
    return settle(rows, blocks, state, _replay, lambda verdicts: _holders(wanted, held, verdicts)).select("seq", "conflict")


def _replay(changes: DataFrame, state: DataFrame) -> DataFrame:
    """Each block's changes in order, from its holders: block, seq, k, v, made, conflict."""

    def replay(changes, state):
        import pyarrow as pa

        holder = dict(zip(state.column("held_v").to_pylist(), state.column("held_by").to_pylist()))
        holds = {k: v for v, k in holder.items()}
        changes = changes.sort_by("seq")
        made, conflict = [], []
        for k, v, fk_ok in zip(*[changes.column(c).to_pylist() for c in ("k", "v", "fk_ok")]):
            taken = v is not None and holder.get(v, k) != k
            conflict.append(taken)
            made.append(fk_ok and not taken)
            if made[-1]:
                holder.pop(holds.pop(k, None), None)
                if v is not None:
                    holder[v], holds[k] = k, v
        return pa.table([*[changes.column(c) for c in ("block", "seq", "k", "v")], pa.array(made, pa.bool_()), pa.array(conflict, pa.bool_())],
                        names=["block", "seq", "k", "v", "made", "conflict"])

    kind = dict(changes.dtypes)
    state = state.select(F.col("block").alias("held_in"), F.col("v").alias("held_v"), F.col("holder").alias("held_by"))
    return changes.groupBy("block").cogroup(state.groupBy("held_in")).applyInArrow(
        replay, f"block {kind['block']}, seq {kind['seq']}, k string, v string, made boolean, conflict boolean")


def _holders(wanted: DataFrame, held: DataFrame, verdicts: DataFrame) -> DataFrame:
    """block, v, holder: who holds each value that a block asks for, when the block begins.

    The last key that took v in an earlier block, else the opening holder, if that key
    has made no change since. Windows hold one row for each block that a value or key occurs in."""
    made = verdicts.where("made")
    taken = made.where("v is not null").groupBy("block", "v").agg(F.max(F.struct("seq", "k")).alias("last"))
    earlier = lambda key: Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = wanted.join(taken, ["block", "v"], "left").select("block", "v", F.max("last").over(earlier("v")).alias("last"))
    likely = (last.join(held, "v", "left").select("block", "v", F.coalesce("last.k", "holder").alias("holder"), F.col("last.seq").alias("since"))
              .where("holder is not null"))
    changed = made.groupBy("block", F.col("k").alias("holder")).agg(F.max("seq").alias("changed"))
    asked = likely.select("block", "holder").distinct().join(changed, ["block", "holder"], "full_outer")
    asked = asked.select("block", "holder", F.max("changed").over(earlier("holder")).alias("changed"))
    return (likely.join(asked, ["block", "holder"]).where(F.col("since").eqNullSafe(F.col("changed")))
            .select("block", "v", "holder"))
