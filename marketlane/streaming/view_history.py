"""View history kept up to date from a stream of view events.

The reference accepts every view, however late, so the stream itself drops
nothing and keeps no state. Per micro-batch (``foreachBatch``) the batch operator
V3 runs against the history of the batch's days (FK checks, one row per customer,
product and day, whenever it comes), and the accepted rows are written to
``<out>/date_viewed=<day>/batch_id=<n>``. Only the folders of the batch's days are
listed and read, so a batch costs the days it touches, however long the history is. A
replayed batch overwrites its own folders with the same rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import ShopTables, stream_driver_table

HISTORY_SCHEMA = "customer_id bigint, product_id bigint, date_viewed date"


def view_event_stream(events: DataFrame) -> DataFrame:
    """Map the driver events stream to view events (same rule as the fixture)."""
    return (events.where(F.col("event_type") == "view")
            .select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("customer_id"),
                    F.regexp_extract(F.col("props"), r"[0-9]+", 0).cast("bigint").alias("product_id")))


def _read_history(spark: SparkSession, out: str, days: list | None = None) -> DataFrame:
    """All batches written so far (any file system), or those of ``days``; empty before the first."""
    schema = HISTORY_SCHEMA + ", batch_id bigint"
    folders = out if days is None else f"{out}/date_viewed={{{','.join(str(d) for d in days)}}}"
    try:
        if days is not None and not days:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", out).parquet(folders)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def stream_record_views(spark: SparkSession, sf_dir: str, out: str | None = None,
                        max_files_per_trigger: int | None = None, events: DataFrame | None = None,
                        base: str | None = None) -> str:
    """Run S1 until the source is drained (``availableNow``); returns the
    history folder. ``events`` overrides the driver events stream. ``base``
    (a stable shared folder) holds the output and the streaming checkpoint, so
    a restarted driver resumes where the last committed batch ended; by
    default a fresh folder under ``spark.checkpoint.dir`` is used."""
    base = base or os.path.join(checkpoint_dir(spark), f"s1-{uuid.uuid4().hex}")
    out = out or os.path.join(base, "history")
    src = events if events is not None else stream_driver_table(spark, sf_dir, "events", max_files_per_trigger)
    stream = view_event_stream(src)

    def apply(batch: DataFrame, batch_id: int) -> None:
        from ..operators.history import record_views

        views = batch.select("seq", "customer_id", "product_id", "ts")
        days = [r[0] for r in views.select(F.to_date("ts")).distinct().collect() if r[0] is not None]     # a calendar's worth at most
        # A replayed batch overwrites its own folders, so they are left out here.
        current = _read_history(spark, out, days).where(F.col("batch_id") != batch_id).drop("batch_id")
        t = ShopTables(spark, sf_dir).with_tables(product_view_history=current)
        res = record_views(t, views)
        accepted = res.outcomes.where(F.col("outcome") == "OK").join(
            current.select("customer_id", "product_id", "date_viewed"),
            ["customer_id", "product_id", "date_viewed"], "left_anti")
        new = accepted.select("customer_id", "product_id", "date_viewed").dropDuplicates().withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        (new.repartition("date_viewed").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date_viewed", "batch_id").parquet(out))

    q = (stream.writeStream.foreachBatch(apply)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_history(spark: SparkSession, out: str) -> DataFrame:
    return _read_history(spark, out).drop("batch_id")
