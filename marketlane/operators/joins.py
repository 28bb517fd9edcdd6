"""Joins of a large table with a small side whose size has been measured.

The planner alone would exchange both sides before AQE can see that one is
small. Here the small side is written to the shared checkpoint folder once, its
rows and bytes are counted there, and it is marked for broadcast only below the
documented limits, so the large scan streams past it. A larger side keeps the
sort-merge join. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# What one broadcast may hold; a hash table of 500,000 rows stays under 100 MB.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32_000_000
FIXED_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: fixed by the type, or as long as the text is."""
    fixed, size = 0, F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        if kind in FIXED_WIDTHS:
            fixed += FIXED_WIDTHS[kind]
        elif kind.startswith("decimal"):
            fixed += 16
        else:
            size = size + F.coalesce(F.octet_length(F.col(name) if kind in ("string", "binary") else F.to_json(F.struct(name))), F.lit(0))
    return size + F.lit(fixed)


def measured(side: DataFrame) -> DataFrame:
    """``side``, written once, and marked for broadcast if it is within the limits."""
    held = materialize(side)
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes(held)).alias("b")).first()
    fits = size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES
    return F.broadcast(held) if fits else held


def sized(side: DataFrame) -> DataFrame:
    """``side``, written once: marked for broadcast if it is within the limits, else for a
    sort-merge join, as the planner may take a large one for small."""
    held = materialize(side)
    marked = measured(held)
    return held.hint("merge") if marked is held else marked


def few_keys(batch: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The distinct values (numbers) of each of ``columns`` in ``batch``, each marked for
    broadcast if it is within the limits: one pass counts them all."""
    if not columns:
        return {}
    counts = batch.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    sides = {c: batch.select(c).where(F.col(c).isNotNull()).distinct() for c in columns}
    few = {c: F.broadcast(side) for c, side in sides.items() if 1.1 * counts[c] <= BROADCAST_ROWS}
    for side in few.values():
        side.__dict__["_few"] = True
    return sides | few


def cut_if_few(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``big`` cut to ``keys`` (a side of ``few_keys``) where they are within the limits, else
    whole: for a join on the keys that follows, which then is the only exchange of ``big``."""
    return big.join(keys, on, "left_semi") if is_few(keys) else big


def is_few(side: DataFrame) -> bool:
    """Whether ``few_keys`` marked ``side`` for broadcast."""
    return bool(side.__dict__.get("_few"))


def many_keys(batch: DataFrame, on: list[str]) -> bool:
    """Whether ``batch`` has more values of ``on`` than one broadcast may hold."""
    return 1.1 * batch.agg(F.approx_count_distinct(F.xxhash64(*on), 0.02)).first()[0] > BROADCAST_ROWS


def cut_to_keys(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``big`` whose ``on`` columns are among those of ``keys``."""
    return big.join(measured(keys.select(*on).distinct()), on, "left_semi")
