"""Vectors of whole numbers for the inner-product operators.

Components are scaled and rounded down on the JVM side. Tasks then work with
matrices of doubles, in which every inner product is a whole number below 2^53 and
so exact. Queries are rows of the same table; they are taken in blocks of bounded
size, each of which is broadcast and meets all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .staging import new_folder, stage

LONGEST = float(2**52)        # squared length up to which products are exact in doubles
BLOCK_VALUES = 1 << 21        # components of the queries of one block: 16 MB as doubles
TILE, CHUNK = 2048, 512       # queries and rows whose scores are held at once: 8 MB


def usable(vector: Column, scale: int) -> Column:
    """True where every component is a finite number and the scaled vector is not too long."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * float(scale), F.lit(2.0)))
    return F.coalesce(vector.isNotNull() & finite & (squares < LONGEST / 4), F.lit(False))


def whole_vectors(df: DataFrame, scale: int, id: Column, vector: Column, **more: Column) -> DataFrame:
    """(id long, values array<double>, norm2 double, and ``more``), where a value is
    floor(scale * component) and norm2 the sum of the squares.

    Left out are rows of null id or null vector, those with a null or non-finite
    component, and those whose scaled length is above 2^25 (their products are no
    longer exact; a unit vector scaled by 256 has length 256)."""
    chosen = df.select(id.cast("long").alias("id"), vector.alias("vector"), *[c.alias(name) for name, c in more.items()])
    chosen = chosen.where(F.col("id").isNotNull() & usable(F.col("vector"), scale))
    values = F.transform("vector", lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    chosen = chosen.select("id", values.alias("values"), *more)
    return chosen.withColumn("norm2", F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def shape(vectors: DataFrame) -> tuple[int, int]:
    """Number of rows, and the width of the longest vector."""
    count, width = vectors.agg(F.count("*"), F.max(F.size("values"))).first()
    return count, width or 0


def query_blocks(queries: DataFrame, values: int, limit: int = BLOCK_VALUES) -> Iterator[pa.Table]:
    """The queries, which hold ``values`` values in all, in blocks of about ``limit``
    values. More than one block is dealt out by a fixed random number and written,
    one folder each."""
    blocks = -(-values // limit)
    if blocks <= 1:
        yield queries.toArrow()
        return
    path = new_folder(queries.sparkSession, "query-blocks")
    queries.withColumn("block", F.floor(F.rand(17) * blocks)).write.partitionBy("block").parquet(path)
    dealt = queries.sparkSession.read.parquet(path)
    for block in range(blocks):
        yield dealt.where(F.col("block") == block).drop("block").toArrow()


def in_blocks(blocks: Iterator[pa.Table], answer, name: str, empty: DataFrame) -> DataFrame:
    """``answer(block)`` of each block that has rows, all together; the answers of
    more than one block are written as they come."""
    answers = [None]
    for block in blocks:
        if block.num_rows:
            if answers[-1] is not None:
                answers[-1] = stage(answers[-1], name)
            answers.append(answer(block))
    out = empty if len(answers) == 1 else answers[1]
    for more in answers[2:]:
        out = out.unionByName(more)
    return out
