"""A kept inverted index of product names (C8, C9), built once and updated by changes.

Three keyed tables in one versioned root (``sources.sinks``):

* ``names``: id and the name's words, by id;
* ``postings``: one row for each word of a product, with the product's id and words, by
  word and share; a word's products are dealt over ``SHARES`` shares by their id, so a
  word that a third of the products hold is no single bucket;
* ``words``: how many products hold each word, by word.

A search reads the buckets of its own words, an update those of the words that the
changed products had or get.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import materialize
from ..sources.sinks import Keyed, latest_version, read_table, write_parts

SHARES = 16


def name_tokens(products: DataFrame) -> DataFrame:
    """(id, tokens) of products (id, name)."""
    return products.select("id", F.coalesce(word_tokens(F.col("name")), F.array().cast("array<string>")).alias("tokens"))


def postings_of(names: DataFrame) -> DataFrame:
    """(word, share, id, tokens): one row for each different word of a name."""
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")
    return names.select(F.explode(F.array_distinct("tokens")).alias("word"), share.alias("share"), "id", "tokens")


def _counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("n_held"))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    root: str

    @classmethod
    def build(cls, products: DataFrame, root: str) -> SearchIndex:
        """The index of ``products`` (id, name), as the first version under ``root``."""
        spark = products.sparkSession
        if latest_version(spark, root) is not None:
            raise ValueError(f"{root} holds an index; update it")
        names = materialize(name_tokens(products))
        postings = postings_of(names)
        write_parts(root, 0, keyed={"names": Keyed(names, ["id"], names), "postings": Keyed(postings, ["word", "share"], postings), "words": Keyed(_counts(postings), ["word"], postings)})
        return cls(spark, root)

    def postings(self, words: DataFrame) -> DataFrame:
        """(word, id, tokens) of the products that hold one of ``words`` (column word)."""
        keys = words.select("word").distinct()
        shares = keys.select("word", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        return read_table(self.spark, self.root, "postings", shares).join(keys, "word", "left_semi").select("word", "id", "tokens")

    def held(self, words: DataFrame) -> DataFrame:
        """(word, n_held) of those of ``words`` that a product holds."""
        keys = words.select("word").distinct()
        return read_table(self.spark, self.root, "words", keys).join(keys, "word", "left_semi").where("n_held > 0")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Products with a new name or new products (id, name; one row an id), and ids
        that are gone, as the next version, whose number is returned."""
        new = materialize(name_tokens(changed))
        ids = new.select("id") if removed is None else new.select("id").unionByName(removed.select("id")).distinct()
        ids = materialize(ids)
        names = read_table(self.spark, self.root, "names", ids)
        old = materialize(names.join(ids, "id", "left_semi"))
        gone, come = postings_of(old), postings_of(new)
        touched = materialize(gone.select("word", "share").unionByName(come.select("word", "share")).distinct())
        postings = read_table(self.spark, self.root, "postings", touched).join(ids, "id", "left_anti").select(*come.columns).unionByName(come)
        step = _counts(come).unionByName(_counts(gone).withColumn("n_held", -F.col("n_held"))).groupBy("word").agg(F.sum("n_held").alias("step"))
        counts = read_table(self.spark, self.root, "words", touched).join(step, "word", "full_outer").select("word", (F.coalesce("n_held", F.lit(0)) + F.coalesce("step", F.lit(0))).alias("n_held"))
        version = latest_version(self.spark, self.root) + 1
        write_parts(self.root, version, keyed={
            "names": Keyed(names.join(ids, "id", "left_anti").unionByName(new), ["id"], ids),
            "postings": Keyed(postings, ["word", "share"], touched),
            "words": Keyed(counts.where("n_held > 0"), ["word"], touched)})
        return version
