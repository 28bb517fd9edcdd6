"""Session helpers.

The library never overrides settings a cluster already provides. ``build_session``
is for tests, benches and local runs; jobs on a cluster receive the cluster's
session and only call ``checkpoint_dir`` to learn where lineage may be cut.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings of local runs; each is set only when the launch left it unset.
# Broadcasts are decided only on measured sizes: the planner's file-size
# estimate is off (-1) and AQE broadcasts a side after its shuffle stage has
# run and proved smaller than the adaptive threshold.
LOCAL_DEFAULTS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings fixed when the JVM starts; applied only when this process starts it
# (a local run), never under spark-submit, where the cluster decides.
LOCAL_STATIC = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "marketlane", extra: dict | None = None) -> SparkSession:
    """A session for tests, benches and the command line.

    Settings from the launch (spark-submit ``--conf``, spark-defaults) are kept:
    on a local master, ``LOCAL_DEFAULTS`` and the default shuffle partitions are
    set where the launch left them unset, on a cluster nothing is; the local master, driver memory and
    ``LOCAL_STATIC`` only when this process starts the JVM itself. Arguments
    given explicitly (``master``, ``shuffle_partitions``, ``extra``) apply.
    """
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ  # the JVM was started by spark-submit
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    if master or not submitted:
        builder = builder.master(master or f"local[{cpus}]")
    if not submitted:
        static = dict(LOCAL_STATIC)
        static["spark.driver.memory"] = os.environ.get("MARKETLANE_DRIVER_MEMORY", "16g")
        for k, v in static.items():
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    launched = spark.sparkContext.getConf()
    local = _is_local(spark)
    if local:
        defaults = dict(LOCAL_DEFAULTS)
        defaults["spark.sql.shuffle.partitions"] = str(int(cpus))
        for k, v in defaults.items():
            if not launched.contains(k):
                spark.conf.set(k, v)
    explicit = dict(extra or {})
    if shuffle_partitions:
        explicit["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in explicit.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    if local:
        checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One process does all the work, so its own folders are shared by all tasks."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    ``spark.checkpoint.dir`` (the cluster names a shared folder there), else the
    folder already set with ``setCheckpointDir``, which is never replaced. With
    neither, a fresh local folder on a local master, and an error on a cluster.
    """
    path, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if not path and held:
        return held
    if not path:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marketlane-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # core setting may be read-only at runtime
            pass
    if not held:
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from there
    (``DataFrame.checkpoint``: reliable, cuts the lineage, survives executor
    loss). Used where several outputs read the same intermediate. A frame that was
    written here before is returned as it is."""
    if df.__dict__.get("_held"):
        return df
    checkpoint_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    held.__dict__["_held"] = True
    return held
