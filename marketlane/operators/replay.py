"""Ordered decisions that depend on all earlier ones, replayed in blocks.

The decisions are cut into blocks of consecutive ones. A block is replayed one by
one, from the state that it finds when it begins, and all blocks are replayed at
once. At first that state is guessed to be the opening one. From the blocks' verdicts
the state at every block's begin is worked out anew, and the blocks that were guessed
wrongly are replayed. The blocks before the first wrong guess are final, so this ends,
after as many rounds as there are blocks at most; a wrong guess seldom outlives a
block. A block and its state are bounded, whatever the size of the batch, or the
share of one key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def in_blocks(rows: DataFrame, order: str, size: int) -> tuple[DataFrame, int]:
    """``rows``, written once, with ``block``: ascending numbers of ranges of ``order`` of
    about ``size`` rows each (rows of one order value share a block); and their number."""
    held = materialize(rows)
    blocks = -(-held.count() // size)
    if blocks <= 1:
        return held.withColumn("block", F.lit(0)), 1
    return materialize(held.repartitionByRange(blocks, order).withColumn("block", F.spark_partition_id())), blocks


def settle(rows: DataFrame, blocks: int, opening: DataFrame, replay: Callable[[DataFrame, DataFrame], DataFrame],
           state_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The verdicts that all blocks agree on.

    ``opening``: the state (``block`` and other columns) as it would be if no earlier
    block changed anything. ``replay(rows, state)``: verdicts, with ``block``.
    ``state_of(verdicts)``: the state that follows from all verdicts, like ``opening``."""
    verdicts = replay(rows, opening)
    if blocks <= 1:
        return verdicts
    state = materialize(opening)
    while True:
        verdicts = materialize(verdicts)
        found = materialize(state_of(verdicts).select(*state.columns))
        both = state.select("*", F.lit(1).alias("_n")).unionByName(found.select("*", F.lit(-1).alias("_n")))
        wrong = materialize(both.groupBy(*state.columns).agg(F.sum("_n").alias("_n")).where("_n != 0").select("block").distinct())
        if wrong.isEmpty():
            return verdicts
        state = found
        again = replay(rows.join(wrong, "block", "left_semi"), state.join(wrong, "block", "left_semi"))
        verdicts = verdicts.join(wrong, "block", "left_anti").unionByName(again)
