"""Basket change feed.

A stream of basket changes (add / update / remove / clear) is applied per
micro-batch (``foreachBatch``) with the batch operator B2 against the basket
as the previous batches left it. State is log-structured under ``<out>``, so a
micro-batch costs what its own customers cost, not the whole basket table:

* ``delta/batch_id=<n>``: the new basket of every customer in batch n (only
  those), and ``touched/batch_id=<n>``: those customers (so an emptied basket
  is represented too);
* ``snap/batch_id=<n>``: a full snapshot, written at batch 0 (opening basket
  plus batch 0) and then every ``COMPACT_EVERY`` batches (compaction);
* ``outcomes/batch_id=<n>``: the outcome of every change;
* ``feed/batch_id=<n>``: one message per customer touched by an accepted add,
  update or remove, ``{"type":"basketUpdate","basket":[{"productId":..,
  "quantity":..}, ..],"part":1,"parts":1}``, holding that customer's basket after the batch (the
  reference pushes the whole basket after each change; within one micro-batch
  the latest state stands for all of that customer's changes);
* ``committed/m=<n>``: a one-row marker (batch, snapshot flag) written last.

The state of a set of customers after batch n is the newest snapshot at or
before n, overridden per customer by the latest delta after it that touched
the customer; it is read only for the customers a batch needs. Folders are
overwritten per batch id and only committed batches are read, so a replayed
batch rewrites the same output.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import ShopTables, stream_driver_table

BASKET_SCHEMA = "customer_id bigint, product_id bigint, quantity bigint"

# The feed message type and the driver event -> basket operation map.
MESSAGE_TYPE = "basketUpdate"
EVENT_OPS = {"click": "add", "signup": "update", "error": "remove", "purchase": "clear"}


def basket_change_stream(events: DataFrame) -> DataFrame:
    """Driver events -> basket changes (same rule as the fixture)."""
    et = F.col("event_type")
    op = F.lit(None).cast("string")
    for kind, name in reversed(list(EVENT_OPS.items())):
        op = F.when(et == kind, F.lit(name)).otherwise(op)
    return (events.where(et != "view")
            .select(F.col("event_id").alias("seq"), F.col("user_id").alias("customer_id"),
                    (F.regexp_extract(F.col("props"), r"[0-9]+", 0).cast("bigint") % 20).alias("product_id"),
                    op.alias("op"), (F.lit(1) + F.col("event_id") % 5).alias("quantity")))


# Most basket lines one message carries; a larger basket is sent in parts.
MESSAGE_PAGE_SIZE = 10_000


def feed_messages(basket: DataFrame, touched: DataFrame, page_size: int = MESSAGE_PAGE_SIZE) -> DataFrame:
    """JSON messages with each touched customer's whole basket (sorted by
    product within a message), ``{"type":"basketUpdate","basket":[...],
    "part":1,"parts":1}``; a customer whose basket became empty gets an empty
    list. Every message has this one shape, whatever the size of the basket.

    A basket is never gathered whole into one task: lines are grouped per
    (customer, page), with the page count from a per-customer count and the
    page from a hash of the product, so a list holds about ``page_size`` lines.
    A page that the hash leaves empty is not sent: ``part`` numbers may have
    gaps, ``parts`` is the number of pages dealt.
    """
    lines = basket.join(touched, "customer_id", "left_semi")
    sizes = lines.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_f_n"))
    parts = F.greatest(F.ceil(F.col("_f_n") / F.lit(page_size)), F.lit(1)).cast("int")
    paged = (lines.join(sizes, "customer_id")
             .withColumn("_f_parts", parts)
             .withColumn("_f_part", F.pmod(F.xxhash64("product_id"), F.col("_f_parts")).cast("int")))
    item = F.struct(F.col("product_id").alias("productId"), F.col("quantity").alias("quantity"))
    grouped = (paged.groupBy("customer_id", "_f_part", "_f_parts")
               .agg(F.sort_array(F.collect_list(item)).alias("basket")))

    def message(basket, part, parts):
        return F.to_json(F.struct(F.lit(MESSAGE_TYPE).alias("type"), basket.alias("basket"),
                                  part.alias("part"), parts.alias("parts"))).alias("message")

    with_lines = grouped.select("customer_id", message(F.col("basket"), F.col("_f_part") + 1, F.col("_f_parts")))
    empty_list = F.array().cast(grouped.schema["basket"].dataType)
    empty = (touched.join(sizes, "customer_id", "left_anti")
             .select("customer_id", message(empty_list, F.lit(1), F.lit(1))))
    return with_lines.unionByName(empty)


def checkout_messages(basket_after: DataFrame, requests: DataFrame) -> DataFrame:
    """After every checkout attempt, whatever its status, the requesting
    customer gets their basket (as the checkout left it)."""
    return feed_messages(basket_after, requests.select("customer_id").distinct())


COMPACT_EVERY = 8


def _markers(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch bigint, snap boolean").parquet(os.path.join(out, "committed"))
    except AnalysisException:
        return None


def _state(spark: SparkSession, out: str, last: int, snap: int, customers: DataFrame | None) -> DataFrame:
    """Basket after committed batch ``last`` whose newest snapshot is ``snap``,
    restricted to ``customers`` (semi join) when given."""
    def only(df):
        return df if customers is None else df.join(customers, "customer_id", "left_semi")

    base = only(spark.read.schema(BASKET_SCHEMA).parquet(os.path.join(out, "snap", f"batch_id={snap}")))
    if last == snap:
        return base
    rng = (F.col("batch_id") > snap) & (F.col("batch_id") <= last)
    touched = only(spark.read.schema("customer_id bigint, batch_id bigint")
                   .parquet(os.path.join(out, "touched")).where(rng))
    latest = touched.groupBy("customer_id").agg(F.max("batch_id").alias("batch_id"))
    deltas = only(spark.read.schema(BASKET_SCHEMA + ", batch_id bigint")
                  .parquet(os.path.join(out, "delta")).where(rng))
    changed = deltas.join(latest, ["customer_id", "batch_id"], "left_semi").drop("batch_id")
    return base.join(latest.select("customer_id"), "customer_id", "left_anti").unionByName(changed)


def _committed_before(spark: SparkSession, out: str, before_batch: int):
    """(last committed batch, its newest snapshot) before ``before_batch``."""
    marks = _markers(spark, out)
    if marks is None:
        return None, None
    row = (marks.where(F.col("batch") < before_batch)
           .agg(F.max("batch").alias("last"), F.max(F.when(F.col("snap"), F.col("batch"))).alias("snap")).first())
    return row["last"], row["snap"]


def stream_basket_feed(spark: SparkSession, sf_dir: str, out: str | None = None,
                       max_files_per_trigger: int | None = None, events: DataFrame | None = None,
                       base: str | None = None) -> str:
    """Run S2 until the source is drained (``availableNow``); returns ``out``.
    ``base`` (a stable shared folder) holds the output and the streaming
    checkpoint so a restarted driver resumes; by default a fresh folder under
    ``spark.checkpoint.dir``."""
    base = base or os.path.join(checkpoint_dir(spark), f"s2-{uuid.uuid4().hex}")
    out = out or os.path.join(base, "out")
    src = events if events is not None else stream_driver_table(spark, sf_dir, "events", max_files_per_trigger)
    changes = basket_change_stream(src)

    def apply(batch: DataFrame, batch_id: int) -> None:
        from ..operators.basket import basket_fold

        t = ShopTables(spark, sf_dir)
        last, snap = _committed_before(spark, out, batch_id)
        in_batch = batch.select("customer_id").distinct()
        # The fold is independent per customer: only this batch's customers are read.
        if last is None:
            current = t.products_in_basket.join(in_batch, "customer_id", "left_semi")
        else:
            current = _state(spark, out, last, snap, in_batch)
        res = basket_fold(current, batch, t.products, t.customer_accounts)
        new_rows = res.basket.select("customer_id", "product_id", "quantity")
        new_rows.write.mode("overwrite").parquet(os.path.join(out, "delta", f"batch_id={batch_id}"))
        in_batch.write.mode("overwrite").parquet(os.path.join(out, "touched", f"batch_id={batch_id}"))
        res.outcomes.write.mode("overwrite").parquet(os.path.join(out, "outcomes", f"batch_id={batch_id}"))
        written = spark.read.schema(BASKET_SCHEMA).parquet(os.path.join(out, "delta", f"batch_id={batch_id}"))
        take_snap = last is None or batch_id % COMPACT_EVERY == 0
        if take_snap:
            others = (t.products_in_basket if last is None else _state(spark, out, last, snap, None))
            full = others.join(in_batch, "customer_id", "left_anti").unionByName(written)
            full.write.mode("overwrite").parquet(os.path.join(out, "snap", f"batch_id={batch_id}"))
        touched = (res.outcomes.where(F.col("op").isin("add", "update", "remove") & (F.col("outcome") == "OK"))
                   .select("customer_id").distinct())
        feed_messages(written, touched).write.mode("overwrite").parquet(os.path.join(out, "feed", f"batch_id={batch_id}"))
        # Commit marker last: a batch that died midway is not read as state.
        (spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(take_snap).alias("snap"))
         .write.mode("overwrite").parquet(os.path.join(out, "committed", f"m={batch_id}")))

    q = (changes.writeStream.foreachBatch(apply)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def final_basket(spark: SparkSession, out: str) -> DataFrame:
    """The basket after the newest committed batch."""
    last, snap = _committed_before(spark, out, 2 ** 62)
    return _state(spark, out, last, snap, None)


def read_feed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "feed"))
