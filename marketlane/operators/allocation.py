"""Stock for requests that compete for it, one at a time.

A request takes all of its lines or none: it is allocated when every line's quantity
is at most what is left of the product, and then uses it up. A refused request leaves
its stock to later ones, so no running sum over all requests decides it. What no order can
change is decided first, by aggregates (``_undisputed``). Of the rest, blocks of
requests are replayed from the amounts that are left when they begin (``replay.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import cut_to_keys
from .replay import in_blocks, settle

BLOCK_LINES = 50_000


def serial_allocation(lines: DataFrame, stock: DataFrame) -> DataFrame:
    """(request_id, allocated BOOLEAN), requests in the order of their id.

    ``lines``: request_id (a whole number, not null), product_id, quantity, and
    available (the product's own flag). ``stock``: product_id, amount. As in a
    three-valued check only a line that is plainly false refuses: too little left, or
    a flag that is false; an unknown amount, quantity or flag lets it pass. Repeated
    lines of a product add up.
    """
    wanted_lines = materialize(lines.groupBy("request_id", "product_id").agg(F.sum("quantity").cast("bigint").alias("quantity"), F.min("available").alias("available")))
    refused, contended = _undisputed(wanted_lines, stock)
    # Few lines are left, each a decision that matters: smaller blocks keep more tasks busy.
    rows, blocks = in_blocks(contended, "request_id", -(-BLOCK_LINES // 4))
    wanted = rows.select("block", "product_id").distinct()
    amounts = cut_to_keys(stock.where("amount is not null").select("product_id", F.col("amount").cast("bigint").alias("amount")), wanted, ["product_id"])
    if blocks > 1:
        wanted, amounts = materialize(wanted), materialize(amounts)
    opening = wanted.join(amounts, "product_id").select("block", "product_id", F.col("amount").alias("left"))

    def left(verdicts: DataFrame) -> DataFrame:
        used = (rows.join(verdicts.where("allocated").select("request_id"), "request_id", "left_semi")
                .groupBy("block", "product_id").agg(F.sum("quantity").alias("used")))
        earlier = Window.partitionBy("product_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = wanted.join(used, ["block", "product_id"], "left").select("block", "product_id", F.coalesce(F.sum("used").over(earlier), F.lit(0)).alias("used"))
        return before.join(amounts, "product_id").select("block", "product_id", (F.col("amount") - F.col("used")).alias("left"))

    disputed = settle(rows, blocks, opening, _replay, left).select("request_id", F.col("allocated").alias("gets"))
    refused = refused.select(F.col("request_id").alias("r"), F.lit(True).alias("refused"))
    disputed = disputed.withColumnRenamed("request_id", "d")
    return (wanted_lines.select("request_id").distinct().join(refused, F.col("request_id").eqNullSafe(F.col("r")), "left")
            .join(disputed, F.col("request_id").eqNullSafe(F.col("d")), "left")
            .select("request_id", (F.col("refused").isNull() & F.coalesce("gets", F.lit(True))).alias("allocated")))


def _undisputed(wanted_lines: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What needs no order: the requests (request_id) that are refused whenever they come,
    and the lines of the others whose product may run out.

    A line is refused at any time when its flag is false, or when it asks for more than
    the amount and all that negative quantities could give back. A product that holds
    what all other requests ask for together refuses none of them.
    """
    gains = wanted_lines.where("quantity < 0").groupBy("product_id").agg(F.sum(-F.col("quantity")).alias("gain"))
    amounts = stock.where("amount is not null").groupBy("product_id").agg(F.max(F.col("amount").cast("bigint")).alias("amount"))
    limits = amounts.join(gains, "product_id", "left").select("product_id", "amount", (F.col("amount") + F.coalesce("gain", F.lit(0))).alias("most"))
    known = materialize(wanted_lines.join(limits, "product_id", "left"))
    never = (F.col("available") == F.lit(False)) | (F.col("quantity") > F.col("most"))
    refused = materialize(known.where(never).select("request_id").distinct())
    open_lines = materialize(known.where("quantity is not null and amount is not null").join(refused.withColumnRenamed("request_id", "r"), F.col("request_id").eqNullSafe(F.col("r")), "left_anti"))
    scarce = (open_lines.groupBy("product_id").agg(F.sum(F.greatest("quantity", F.lit(0))).alias("asked"), F.max("amount").alias("amount"))
              .where("asked > amount"))
    return refused, cut_to_keys(open_lines, scarce, ["product_id"]).select("request_id", "product_id", "quantity", "available")


def _replay(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Each block's requests in order, from what is left: block, request_id, allocated."""

    def replay(rows, state):
        import pyarrow as pa

        left = dict(zip(state.column("of_product").to_pylist(), state.column("left").to_pylist()))
        requests: dict = {}
        rows = rows.sort_by("request_id")
        for request, *line in zip(*[rows.column(c).to_pylist() for c in ("request_id", "product_id", "quantity", "available")]):
            requests.setdefault(request, []).append(line)
        allocated = []
        for own in requests.values():
            fits = all(flag is not False and (q is None or p not in left or q <= left[p]) for p, q, flag in own)
            allocated.append(fits)
            for p, q, _ in own if fits else ():
                if q is not None and p in left:
                    left[p] -= q
        block = rows.column("block")[0].as_py() if len(rows) else 0
        return pa.table({"block": pa.array([block] * len(requests), pa.int32()), "request_id": pa.array(list(requests), pa.int64()), "allocated": pa.array(allocated, pa.bool_())})

    rows = rows.withColumn("request_id", F.col("request_id").cast("bigint"))
    state = state.select(F.col("block").alias("held_in"), F.col("product_id").alias("of_product"), "left")
    return rows.groupBy("block").cogroup(state.groupBy("held_in")).applyInArrow(replay, "block int, request_id bigint, allocated boolean")
