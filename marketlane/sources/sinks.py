"""T5: sink for keyed changes.

A root folder holds named parts, written in numbered versions:

    <root>/<part>/v=<version>/                   a part written whole (outcomes, new orders)
    <root>/<part>/v=<version>/bucket=<bucket>/   a keyed table, of which only the buckets
                                                 with a changed key are written
    <root>/commits/v=<version>/                  one file, written last: what the version holds

A row of a keyed table is in the bucket that its key's hash names. A bucket's rows are
those of the newest committed version that wrote it, so a small batch writes a few
buckets of bounded size, however large the table is, and reads no others. A job that
fails before its commit file leaves the earlier versions as they are (the batch
counterpart of ROLLBACK); a retry of a version overwrites its own folders.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_BUCKET = 200_000
# Folders that are named to the reader one by one; more are chosen by a join. The rows are the same.
NAMED_FOLDERS = 2_000
COMMIT = "version bigint, part string, bucket int, n_rows bigint, buckets int, key array<string>, columns string"


@dataclass
class Keyed:
    """A keyed table to write: ``table`` after the changes and ``touched``, which has
    the keys (columns ``key``) whose rows may differ from the version before."""

    table: DataFrame
    key: list[str]
    touched: DataFrame


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).parquet(f"{root.rstrip('/')}/commits").select(*[c.split()[0] for c in COMMIT.split(", ")])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest committed version, None before the first."""
    commits = _commits(spark, root)
    return None if commits is None else commits.select(F.max("version")).first()[0]


def write_parts(root: str, version: int, whole: dict[str, DataFrame] | None = None, keyed: dict[str, Keyed] | None = None) -> str:
    """Write ``whole`` parts and the touched buckets of ``keyed`` tables as ``version``
    and commit it. A keyed table that no version holds yet is written in all its
    buckets, one for each ``ROWS_PER_BUCKET`` rows. Returns the commit's folder."""
    whole, keyed = whole or {}, keyed or {}
    spark = next(iter([*whole.values(), *[k.table for k in keyed.values()]])).sparkSession
    base, version = root.rstrip("/"), int(version)
    before = _commits(spark, root)
    entry = [F.lit(version).cast("bigint").alias("version")]
    rows = []
    for name, df in whole.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/v={version}")
        rows.append(spark.range(1).select(*entry, F.lit(name).alias("part"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("n_rows"),
                                          F.lit(None).cast("int").alias("buckets"), F.lit(None).cast("array<string>").alias("key"), F.lit(None).cast("string").alias("columns")))
    for name, k in keyed.items():
        held = None if before is None else before.where((F.col("part") == name) & (F.col("version") != version)).select("buckets", "key").first()
        if held is not None and list(held["key"]) != list(k.key):
            raise ValueError(f"{name} is kept by {list(held['key'])}, not by {list(k.key)}")
        buckets = held["buckets"] if held is not None else max(1, -(-k.table.count() // ROWS_PER_BUCKET))
        table = k.table.withColumn("bucket", _bucket(k.key, buckets))
        if held is not None:
            touched = k.touched.select(_bucket(k.key, buckets).alias("bucket")).distinct()
            table = table.join(touched, "bucket", "left_semi")
        else:
            touched = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        path = f"{base}/{name}/v={version}"
        table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = spark.read.schema(table.schema).parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
        columns = k.table.schema.json()
        rows.append(touched.join(written, "bucket", "left").select(
            *entry, F.lit(name).alias("part"), "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(buckets).alias("buckets"),
            F.array(*[F.lit(c) for c in k.key]).alias("key"), F.lit(columns).alias("columns")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    # One file, so that it is there in full or not at all: a short row for each bucket written.
    out.coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/v={version}")
    return f"{base}/commits/v={version}"


def write_changes(result, root: str, version: int, key: list[str] | None = None) -> str:
    """Write a ``ChangeResult``'s outcomes and table. With ``key`` (columns of both)
    only the buckets of accepted changes' keys are written, else the whole table."""
    if key is None:
        return write_parts(root, version, {"table": result.table, "outcomes": result.outcomes})
    touched = result.outcomes.where(F.col("outcome") == "OK").select(*key)
    return write_parts(root, version, {"outcomes": result.outcomes}, {"table": Keyed(result.table, key, touched)})


def read_table(spark: SparkSession, root: str, part: str = "table", keys: DataFrame | None = None) -> DataFrame | None:
    """The newest committed rows of ``part``, None before the first version. With
    ``keys`` (a table with the part's key columns), only the buckets of those keys."""
    base, commits = root.rstrip("/"), _commits(spark, root)
    commits = None if commits is None else commits.where(F.col("part") == part)
    newest = None if commits is None else commits.orderBy(F.col("version").desc()).first()
    if newest is None:
        return None
    if newest["bucket"] is None:
        return spark.read.parquet(f"{base}/{part}/v={newest['version']}")
    schema = StructType.fromJson(json.loads(newest["columns"]))
    current = commits.groupBy("bucket").agg(F.max_by(F.struct(F.col("version").alias("v"), "n_rows"), "version").alias("at"))
    current = current.where("at.n_rows > 0").select("bucket", "at.v")
    if keys is not None:
        current = current.join(keys.select(_bucket(list(newest["key"]), newest["buckets"]).alias("bucket")).distinct(), "bucket", "left_semi")
    folders = current.limit(NAMED_FOLDERS + 1).collect()
    whole = StructType([*schema.fields]).add("v", "long").add("bucket", "integer")
    reader = spark.read.schema(whole).option("basePath", f"{base}/{part}")
    if not folders:
        return spark.createDataFrame([], schema)
    if len(folders) <= NAMED_FOLDERS:
        return reader.parquet(*[f"{base}/{part}/v={r['v']}/bucket={r['bucket']}" for r in folders]).select(*schema.names)
    return reader.parquet(f"{base}/{part}").join(F.broadcast(current), ["v", "bucket"], "left_semi").select(*schema.names)


def retire(spark: SparkSession, root: str, part: str) -> int:
    """Delete the folders of a keyed part that no current bucket is in, those of
    versions that were never committed included. Returns how many."""
    base, commits = f"{root.rstrip('/')}/{part}", _commits(spark, root).where(F.col("part") == part)
    kept = {(r["v"], r["bucket"]) for r in commits.groupBy("bucket").agg(F.max("version").alias("v")).toLocalIterator()}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for version in fs.listStatus(path(base)):
        number = int(version.getPath().getName().removeprefix("v="))
        for bucket in fs.listStatus(version.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in kept:
                gone += fs.delete(bucket.getPath(), True)
    return gone
