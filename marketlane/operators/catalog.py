"""Catalogue reads.

``product_catalog`` rebuilds the shop's product view as a DataFrame: product,
base product, brand (nullable), stock, availability and the price in force on a
day. Every reader below starts from it, so Catalyst prunes the joins and
columns a reader does not use.

Scale notes: products and prices are the large inputs; brands, base products
and types are bounded by the brand x type domain and are left to AQE, which
broadcasts them after measuring the shuffle output
(``spark.sql.adaptive.autoBroadcastJoinThreshold``) and keeps a sort-merge
join otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents_to_amount
from .joins import cut_if_few, cut_to_keys, few_keys, measured
from .scan import Running, running

# Column sets the reference returns.
DETAIL_COLUMNS = ["id", "name", "available", "brand_name", "brand_id", "stock_count", "price", "description"]
LISTING_COLUMNS = ["id", "name", "description", "brand_id", "brand_name", "available", "stock_count", "price"]
SHORT_COLUMNS = ["id", "name", "available", "stock_count", "price"]
HOT_STYLE = 100_000     # products of a style that one share holds


def _day(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of).cast("date")


def price_as_of(prices: DataFrame, as_of) -> DataFrame:
    """Latest price per product dated on or before ``as_of``.

    One aggregate (partial + final around a single exchange); ``max_by`` keeps
    the row with the greatest date, which is unique per product.
    """
    return (prices.where(F.col("date_active_from") <= _day(as_of))
            .groupBy("product_id")
            .agg(F.max_by("price_cents", "date_active_from").alias("price_cents"),
                 F.max("date_active_from").alias("price_date")))


def price_on_days(prices: DataFrame, requests: DataFrame) -> DataFrame:
    """C2 for many days: each request (``request_id``, ``product_id``, ``day``) with the
    product's latest price dated on or before its day (NULLs when there is none, or
    the day or product is NULL).

    An as-of join without pairing requests and prices: both are laid out by product and
    day, prices first within a day, and every request takes the last price before it
    (``scan.running``, which splits a product with many rows). Prices are first cut to
    the requested products."""
    asked = requests.select("request_id", "product_id", "day")
    known = asked.where(F.col("product_id").isNotNull() & F.col("day").isNotNull())
    dated = cut_to_keys(prices.select("product_id", "date_active_from", "price_cents"), known, ["product_id"])
    none = F.lit(None)
    line = dated.select("product_id", F.struct(F.col("date_active_from").alias("day"), F.lit(0).alias("kind"), F.col("price_cents").alias("tie")).alias("at"),
                        F.struct("price_cents", F.col("date_active_from").alias("price_date")).alias("price"), none.cast("bigint").alias("request_id"))
    request = known.select("product_id", F.struct("day", F.lit(1).alias("kind"), F.col("request_id").alias("tie")).alias("at"),
                           none.cast(line.schema["price"].dataType).alias("price"), "request_id")
    found = running(line.unionByName(request), ["product_id"], "at", [Running("last", "last", "price")]).where(F.col("at.kind") == 1)
    return (asked.join(found.select("request_id", "last"), "request_id", "left")
            .select("request_id", "product_id", "day", F.col("last.price_cents").alias("price_cents"), F.col("last.price_date").alias("price_date")))


def product_catalog(tables, as_of, ids: DataFrame | None = None) -> DataFrame:
    """One row per product (the product view), or per product whose id is in
    ``ids`` (``product_id``).

    LEFT joins throughout: a product without base, brand, stock row or price
    keeps its row with NULLs. With ``ids`` the products, stock rows and the price log
    are cut to them first, so for a few ids none of the three is exchanged. For more ids
    than one broadcast holds, only the products are: the stock rows and the price log
    meet them in the joins that they need anyway.
    """
    if ids is not None:
        asked = few_keys(ids, ["product_id"])["product_id"]
        cut = {n: cut_if_few(getattr(tables, n), asked, "product_id") for n in ("product_stock_levels", "product_prices")}
        tables = tables.with_tables(products=tables.products.join(asked.withColumnRenamed("product_id", "id"), "id", "left_semi"), **cut)
    p = tables.products
    b = tables.base_products.select(F.col("id").alias("_base_id"), "brand_id")
    br = tables.brands.select(F.col("id").alias("_brand_id"), F.col("name").alias("brand_name"))
    stock = tables.product_stock_levels.select(F.col("product_id").alias("_stock_pid"),
                                               F.col("amount").alias("stock_count"))
    price = price_as_of(tables.product_prices, as_of).select(F.col("product_id").alias("_price_pid"), "price_cents")
    return (p.join(b, p.base_product_id == b._base_id, "left")
            .join(br, F.col("brand_id") == br._brand_id, "left")
            .join(stock, p.id == stock._stock_pid, "left")
            .join(price, p.id == price._price_pid, "left")
            .select("id", "name", "description", "base_product_id", "brand_id", "brand_name",
                    "available", "stock_count", "price_cents",
                    cents_to_amount(F.col("price_cents")).alias("price")))


def products_by_type(catalog: DataFrame, assigned: DataFrame, type_id: int | None = None) -> DataFrame:
    """Catalogue rows per assigned type, joined on the *base* product id.

    A product appears once per type of its base product.
    """
    a = assigned.select(F.col("product_id").alias("_base"), "type_id")
    if type_id is not None:
        a = a.where(F.col("type_id") == F.lit(type_id))
    return (catalog.join(a, catalog.base_product_id == a._base)
            .select("type_id", *LISTING_COLUMNS))


def products_by_brand(catalog: DataFrame, brand_id: int | None = None) -> DataFrame:
    """C4: catalogue rows of one brand, or of every branded product."""
    cond = F.col("brand_id").isNotNull() if brand_id is None else F.col("brand_id") == F.lit(brand_id)
    return catalog.where(cond).select(*LISTING_COLUMNS)


def product_detail(catalog: DataFrame, product_id: int | None = None) -> DataFrame:
    """The full catalogue row (0 or 1 row for one id)."""
    out = catalog if product_id is None else catalog.where(F.col("id") == F.lit(product_id))
    return out.select(*DETAIL_COLUMNS)


def products_same_style(catalog: DataFrame, products: DataFrame, product_id: int) -> DataFrame:
    """C6 for one id: every variant sharing the product's base, itself included.

    The base id comes from an uncorrelated scalar subquery that Spark runs once
    and uses as a filter on the catalogue scan.
    """
    base = products.where(F.col("id") == F.lit(int(product_id))).select("base_product_id").scalar()
    return catalog.where(F.col("base_product_id") == base).select(*SHORT_COLUMNS)


def products_same_style_for(catalog: DataFrame, products: DataFrame, requests: DataFrame) -> DataFrame:
    """C6 for a table of requested product ids (``request_id``, ``product_id``): the
    variants that share the product's base, the product itself included.

    The output is the sum of the requested styles' sizes, the size of the answer.
    Styles are counted; one of more than ``HOT_STYLE`` products is cut into as many
    shares of its products, and its requests go to every share.
    """
    base = cut_to_keys(products.select(F.col("id").alias("product_id"), F.col("base_product_id").alias("_b")), requests, ["product_id"])
    r = requests.join(base, "product_id").where(F.col("_b").isNotNull())
    c = cut_to_keys(catalog.withColumnRenamed("base_product_id", "_b"), r, ["_b"])
    hot = c.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / HOT_STYLE).cast("int").alias("_n")).where("_n > 1")
    hot = measured(hot)
    share = F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")
    c = c.join(hot, "_b", "left").withColumn("_share", share)
    r = r.join(hot, "_b", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)))
    return (r.drop("_n").join(c.drop("_n"), ["_b", "_share"])
            .select("request_id", F.col("product_id").alias("requested_id"), *SHORT_COLUMNS))


def style_index(catalog: DataFrame) -> DataFrame:
    """C6 over all products without pairing them: each product with its style
    (base product) and the style's size. A lookup of any product's variants is
    then a filter on ``style_id``.

    The per-style count is an aggregate (combined map-side) joined back, so a
    style holding a third of the products is never one window partition; AQE
    splits the skewed join partition.
    """
    sizes = (catalog.groupBy(F.col("base_product_id").alias("_style"))
             .agg(F.count(F.lit(1)).alias("n_variants")))
    return (catalog.join(sizes, F.col("base_product_id") == sizes._style, "left")
            .select(*SHORT_COLUMNS, F.col("base_product_id").alias("style_id"), "n_variants"))


def random_products(catalog: DataFrame, n=1, seed: int = 0) -> DataFrame:
    """``n`` products in random order (a non-numeric ``n`` means 1).

    The order is that of a keyed hash, MD5 of the seed and the id, so a seed always
    draws the same products, another one others, and samples of parts of the
    catalogue merge by taking the first ``n`` again. Plans as TakeOrderedAndProject:
    each task keeps its own first ``n`` and only those reach the final merge.
    """
    try:
        k = int(n)
    except (TypeError, ValueError):
        k = 1
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    return (catalog.select(*SHORT_COLUMNS, drawn.alias("_r"))
            .orderBy("_r", "id").limit(max(k, 0)).drop("_r"))
