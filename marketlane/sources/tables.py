"""Named table scans.

Driver tables are read with an explicit schema (no inference, no footer merge);
column pruning and filters reach the parquet scan because every read is a plain
``spark.read.schema(..).parquet(..)`` that Catalyst can see through.

``ShopTables`` exposes the driver tables and the shop tables derived from them
(see ``fixtures.py``) as attributes; each DataFrame is built once per object and
stays lazy.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()),
        T.StructField("r_name", T.StringType()),
    ]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "supplier": T.StructType([
        T.StructField("s_suppkey", T.LongType()),
        T.StructField("s_name", T.StringType()),
        T.StructField("s_nationkey", T.IntegerType()),
        T.StructField("s_acctbal", T.DoubleType()),
    ]),
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; accepts ``<dir>/<name>.parquet`` file or folder."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.read
    schema = DRIVER_SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


class ShopTables:
    """Lazy name -> DataFrame mapping over one data folder.

    Driver tables (``part``, ``lineitem`` ...) are scans; shop tables
    (``products``, ``shop_orders`` ...) are DataFrame derivations from
    ``fixtures.py``. Overrides let tests and batch jobs swap in any table with
    the same schema (for example the output of a previous change job).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._overrides: dict[str, DataFrame] = dict(overrides or {})
        self._frames: dict[str, DataFrame] = dict(self._overrides)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        frames = self.__dict__["_frames"]
        if name not in frames:
            frames[name] = self._build(name)
        return frames[name]

    def _build(self, name: str) -> DataFrame:
        from . import fixtures

        if name in DRIVER_SCHEMAS:
            return read_driver_table(self.spark, self.sf_dir, name)
        builder = fixtures.BUILDERS.get(name)
        if builder is None:
            raise KeyError(f"unknown table {name!r}")
        return builder(self)

    def with_tables(self, **frames: DataFrame) -> "ShopTables":
        """A copy where the named tables are replaced (e.g. after a change job)."""
        merged = dict(self.__dict__["_overrides"])
        merged.update(frames)
        return ShopTables(self.spark, self.sf_dir, merged)


def load_tables(spark: SparkSession, sf_dir: str) -> ShopTables:
    return ShopTables(spark, sf_dir)


def stream_driver_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None):
    """A streaming scan of a driver table (a folder of parquet files, or one file).

    The file source needs a folder or a glob; a single file is addressed by a
    glob matching only itself.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    if not os.path.isdir(path):
        head, tail = os.path.split(path)
        path = os.path.join(head, f"[{tail[0]}]{tail[1:]}")
    reader = spark.readStream.schema(DRIVER_SCHEMAS[name])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
