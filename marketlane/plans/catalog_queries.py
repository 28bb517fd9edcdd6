"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.validation import is_array_of_numbers, is_array_of_strings
from ..operators import catalog as c
from .registry import AS_OF, register

LIST_VALUES = ["7", "-1.5e3", "NaN", "", "  ", "0x1F", "0b12", "1d", ".5", "5.", ".", "Infinity", "-Infinity", "inf", " 12\t", "1 2", "1_000", "Brand", None]


@register("price_as_of")
def q_price_as_of(t):
    return c.price_as_of(t.product_prices, AS_OF)


@register("product_catalog")
def q_product_catalog(t):
    return c.product_catalog(t, AS_OF)


@register("products_by_type")
def q_products_by_type(t):
    return c.products_by_type(c.product_catalog(t, AS_OF), t.assigned_product_type)


@register("products_by_brand")
def q_products_by_brand(t):
    return c.products_by_brand(c.product_catalog(t, AS_OF))


@register("product_detail")
def q_product_detail(t):
    return c.product_detail(c.product_catalog(t, AS_OF))


@register("price_on_days")
def q_price_on_days(t):
    """The price of every ordered product on the day of its order."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = lines.select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")).alias("request_id"), F.col("l_partkey").alias("product_id"),
                        F.col("o_orderdate").cast("date").alias("day")).distinct()
    return c.price_on_days(t.product_prices, days)


@register("products_same_style")
def q_products_same_style(t):
    """Every supplier's request: the variants of one product."""
    key = F.col("s_suppkey")
    requests = t.supplier.select(key.alias("request_id"), (key * 7 % 1500 + 1).cast("bigint").alias("product_id"))
    return c.products_same_style_for(c.product_catalog(t, AS_OF), t.products, requests)


@register("style_index")
def q_style_index(t):
    return c.style_index(c.product_catalog(t, AS_OF))


@register("random_products")
def q_random_products(t):
    return c.random_products(c.product_catalog(t, AS_OF), n=10, seed=7)


@register("request_list_check")
def q_request_list_check(t):
    """The list checks on lists of a part's values: numbers in several notations, texts, blanks, NULLs."""
    key = F.col("p_partkey")
    odd = F.element_at(F.array(*[F.lit(x) for x in LIST_VALUES]), (key % len(LIST_VALUES) + 1).cast("int"))
    values = F.when(key % 17 == 0, F.lit(None)).otherwise(F.array(F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), odd))
    return t.part.select(key.alias("request_id"), is_array_of_numbers(values).alias("numbers"), is_array_of_strings(values).alias("strings"))
