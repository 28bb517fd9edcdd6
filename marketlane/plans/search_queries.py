"""Registered search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import search as s
from .registry import AS_OF, register

SEARCH_TEXT = "red or blue -small"
PHRASE_TEXT = '"hot gear" or widget'


@register("product_search")
def q_product_search(t):
    return s.product_search(c.product_catalog(t, AS_OF), SEARCH_TEXT)


@register("product_search_phrase")
def q_product_search_phrase(t):
    return s.product_search(c.product_catalog(t, AS_OF), PHRASE_TEXT)


def _queries(t):
    """Stand-in query table: for every distinct product name, the name as
    words, as a phrase, as an alternative, with an exclusion, as an alternative
    with an exclusion, as one exclusion only, and as one of these with an alternative."""
    names = t.part.select(F.col("p_name").alias("n")).distinct()
    w = F.split("n", " ")
    kinds = F.array(
        F.struct(F.lit("and").alias("kind"), F.col("n").alias("query")),
        F.struct(F.lit("phrase").alias("kind"), F.concat(F.lit('"'), F.col("n"), F.lit('"')).alias("query")),
        F.struct(F.lit("or").alias("kind"), F.concat(w[0], F.lit(" or "), w[1]).alias("query")),
        F.struct(F.lit("not").alias("kind"), F.concat(w[1], F.lit(" -"), w[0]).alias("query")),
        F.struct(F.lit("mixed").alias("kind"), F.concat(w[1], F.lit(" or "), w[0], F.lit(" -"), w[1]).alias("query")),
        F.struct(F.lit("neg").alias("kind"), F.concat(F.lit("-"), w[0]).alias("query")),
        F.struct(F.lit("neg_or").alias("kind"), F.concat(F.lit("-"), w[0], F.lit(" or "), w[1]).alias("query")),
    )
    q = names.select(F.explode(kinds).alias("q"))
    return q.select(F.concat(F.col("q.kind"), F.lit(":"), F.col("q.query")).alias("query_id"), F.col("q.query"))


@register("product_search_batch")
def q_product_search_batch(t):
    return s.product_search_batch(c.product_catalog(t, AS_OF), _queries(t), t.products).matches


@register("product_search_unanchored")
def q_product_search_unanchored(t):
    return s.product_search_batch(c.product_catalog(t, AS_OF), _queries(t), t.products).complement


@register("product_search_index")
def q_product_search_index(t):
    """The batch by a kept index: built from every product under an older name, then
    updated with the names of today, some products gone and some new."""
    from ..operators.search_index import SearchIndex
    from ..session import checkpoint_dir

    root = f"{checkpoint_dir(t.spark).rstrip('/')}/search-index-{uuid.uuid4().hex}"
    key = F.col("id")
    before = t.products.select(key, F.when(key % 3 == 0, F.concat(F.lit("old "), "name")).otherwise(F.col("name")).alias("name")).where(key % 5 != 0)
    before = before.unionByName(t.products.select((-key).alias("id"), "name"))
    index = SearchIndex.build(before, root)
    index.update(t.products.where((key % 3 == 0) | (key % 5 == 0)).select("id", "name"), t.products.select((-key).alias("id")))
    return s.product_search_batch(c.product_catalog(t, AS_OF), _queries(t), index=index).matches
