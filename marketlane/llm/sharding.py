"""Consistent sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table; the
shards take turns, each claiming its best free slot, until the table is full. A
key's slot is its hash modulo the table size. Shards get equal numbers of slots
(one more or less), and adding or removing a shard moves few other keys. The
table's size is a parameter, so it goes into the plan as a literal.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .staging import fresh

TABLE_SIZE = 65_537


def _hash(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard in each slot."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size must be prime, not {size}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("need between one and table-size shards with different names")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot, from the first 60 bits of the MD5 of its text; a null key is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (LONG) and ``shard`` (STRING), row by row, without a
    shuffle; columns of ``df`` with these names are replaced."""
    table = lookup_table(shards, size)
    index = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    names = F.split(F.lit("\n".join(shards)), "\n")
    placed = df.withColumn("slot", slot_of(df[key], size))
    return placed.withColumn("shard", F.get(names, F.get(index, F.col("slot").cast("int"))))


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """``df`` written to ``path/shard=<name>/``. Rows of a shard are dealt over
    ``files_per_shard`` tasks by position, so a key with many rows does not end up in one task."""
    file = fresh("file", df.columns)
    placed = place(df, key, shards, size).withColumn(file, F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard)))
    placed.repartition("shard", file).drop(file).write.partitionBy("shard").parquet(path)
