"""Helpers shared by the operators: column choice, written intermediate tables, partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir

PARTITION_BYTES = 32_000_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names. Everything else
    in ``df``, clashing names included, is left out here."""
    return df.select(*[df[name].alias(own) for own, name in columns.items()])


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until it clashes with none of ``taken`` (case aside)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark, name: str) -> str:
    """A path of its own in the shared folder the cluster names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back: later
    jobs neither repeat the work nor depend on any executor's disk."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, text: str, size: int = PARTITION_BYTES) -> int:
    """Number of partitions that hold about ``size`` bytes of ``text`` each, at
    least ``spark.sql.shuffle.partitions``."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def with_types(schema: str, **types) -> str:
    """A schema string with the types of the caller's own columns filled in."""
    return schema.format(**{k: v.simpleString() for k, v in types.items()})
