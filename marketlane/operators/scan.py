"""Running aggregates per key in order that stay parallel under skew.

A plain ``Window.partitionBy(key).orderBy(order)`` puts every row of a key in one
task; a key holding a third of the data would be one straggler task. Here the rows
are dealt by counted ranges of (key, order), so a key with many rows lies in as many
ranges as its share asks for, however its orders are spaced. The window runs per
(key, range). A small window over the ranges of a key gives each range its carry-in;
only a key that a range boundary cuts has one, so there are fewer carries than ranges
and they are broadcast.

Supported running aggregates (associative, so the carry composes):
``last`` (last non-NULL value) and ``sum``, each inclusive or exclusive of
the current row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Running:
    out: str
    kind: str  # "last" | "sum"
    value: str
    exclusive: bool = True


def ranged(df: DataFrame, keys: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """``df``, written once, with ``_s_range``: ascending numbers of ranges of (keys,
    order) with about equal counts of rows, ``spark.sql.shuffle.partitions`` at most
    unless ``ranges`` is given."""
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys, order)
    return materialize(dealt.withColumn("_s_range", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: str, specs: list[Running], ranges: int | None = None) -> DataFrame:
    """Add one column per spec: the running aggregate of ``value`` over the
    rows of the same ``keys`` ordered by ``order`` (unique within a key; any
    type that sorts). Keys must not be NULL."""
    b = ranged(df, keys, order, ranges)
    part = [*keys, "_s_range"]
    end = {s.out: -1 if s.exclusive else 0 for s in specs}

    def over(s: Running, value: str, window) -> F.Column:
        return F.last(value, ignorenulls=True).over(window) if s.kind == "last" else F.sum(value).over(window)

    local = b
    for s in specs:
        local = local.withColumn(f"_s_loc_{s.out}", over(s, s.value, Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, end[s.out])))

    totals = [(F.max_by(F.col(s.value), F.when(F.col(s.value).isNotNull(), F.col(order))) if s.kind == "last" else F.sum(s.value)).alias(f"_s_tot_{s.out}") for s in specs]
    earlier = Window.partitionBy(*keys).orderBy("_s_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(*part).agg(*totals).select(*part, *[over(s, f"_s_tot_{s.out}", earlier).alias(f"_s_car_{s.out}") for s in specs])
    some = F.lit(False)
    for s in specs:
        some = some | F.col(f"_s_car_{s.out}").isNotNull()

    out = local.join(F.broadcast(carry.where(some)), part, "left")     # fewer rows than ranges
    for s in specs:
        loc, car = F.col(f"_s_loc_{s.out}"), F.col(f"_s_car_{s.out}")
        value = F.coalesce(loc, car) if s.kind == "last" else F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        out = out.withColumn(s.out, value)
    return out.drop("_s_range", *[f"_s_{x}_{s.out}" for s in specs for x in ("loc", "car")])
