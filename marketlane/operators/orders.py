"""Order reads and the checkout building blocks.

All functions work on every customer and order at once; an optional id filter
is a plain ``where`` that Catalyst pushes into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import apply_percent_off, cents_to_amount
from . import catalog as cat
from .joins import cut_to_keys, measured


def orders_with_products(tables) -> DataFrame:
    """O1: one row per order line with the order's customer and date."""
    o = tables.shop_orders.select(F.col("id").alias("order_id"), "customer_id",
                                  F.col("placed_on").alias("order_placed_on"))
    return (o.join(tables.product_orders, "order_id")
            .select("order_id", "customer_id", "order_placed_on", "product_id", "quantity",
                    F.col("price_cents").alias("item_price_cents")))


def _line_totals(product_orders: DataFrame) -> DataFrame:
    # Pre-aggregate the lines per order before meeting the orders table: one
    # partial + final aggregate, then a 1:1 join on the same key.
    return (product_orders.groupBy("order_id")
            .agg(F.count("product_id").alias("product_count"),
                 F.sum(F.col("price_cents") * F.col("quantity")).alias("total_cents")))


def order_history(tables, customer_id: int | None = None) -> DataFrame:
    """O2: per order its status, address id, line count, line total, price paid, date.

    LEFT to statuses and lines (no lines: count 0, total NULL); the address is
    an INNER match, so an order whose address row is gone disappears. Addresses
    are keyed by id, so the inner join is a semi join and never multiplies rows.
    """
    o = tables.shop_orders
    po = tables.product_orders
    if customer_id is not None:
        o = o.where(F.col("customer_id") == F.lit(customer_id))
        # Selective: keep only this customer's lines before aggregating them.
        po = po.join(o.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    addresses = tables.shipping_addresses.select(F.col("id").alias("shipping_address_id"))
    o = o.join(addresses, "shipping_address_id", "left_semi")
    # A few statuses carry all orders: a shuffle on them would put the table in a few tasks.
    st = measured(tables.order_statuses.select(F.col("id").alias("status_id"), "status"))
    lines = _line_totals(po).withColumnRenamed("order_id", "id")
    return (o.join(st, "status_id", "left")
            .join(lines, "id", "left")
            .select("id", "customer_id", "status", "shipping_address_id",
                    F.coalesce("product_count", F.lit(0)).alias("product_count"),
                    cents_to_amount(F.col("total_cents")).alias("total"),
                    cents_to_amount(F.col("price_paid_cents")).alias("price_paid"),
                    "placed_on"))


def order_history_sorted(tables, customer_id: int | None = None) -> DataFrame:
    """O2 with the reference's order: newest first (id breaks ties)."""
    return order_history(tables, customer_id).orderBy(F.desc("placed_on"), F.desc("id"))


def order_details(tables, customer_id: int | None = None, order_id: int | None = None) -> DataFrame:
    """O3: O2 for one order of one customer, without the address id."""
    h = order_history(tables, customer_id)
    if order_id is not None:
        h = h.where(F.col("id") == F.lit(order_id))
    return h.drop("shipping_address_id")


def order_products(tables, as_of, customer_id: int | None = None, order_id: int | None = None) -> DataFrame:
    """Lines of orders with the product's *current* catalogue name (LEFT, may be NULL)."""
    lines = orders_with_products(tables)
    if customer_id is not None:
        lines = lines.where(F.col("customer_id") == F.lit(customer_id))
    if order_id is not None:
        lines = lines.where(F.col("order_id") == F.lit(order_id))
    names = tables.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (lines.join(names, "product_id", "left")
            .select("order_id", "customer_id", "product_id", "product_name", "quantity",
                    cents_to_amount(F.col("item_price_cents")).alias("price")))


def order_discounts(tables, customer_id: int | None = None, order_id: int | None = None) -> DataFrame:
    """Codes used by orders. The reference's customer filter on the right
    side of its LEFT joins makes them inner; here both sides are plain joins."""
    links = tables.discount_codes_for_order
    if order_id is not None:
        links = links.where(F.col("order_id") == F.lit(order_id))
    codes = tables.discount_codes.select(F.col("id").alias("discount_code_id"), "code")
    o = tables.shop_orders.select(F.col("id").alias("order_id"), "customer_id")
    if customer_id is not None:
        o = o.where(F.col("customer_id") == F.lit(customer_id))
    return (links.join(codes, "discount_code_id", "left")
            .join(o, "order_id")
            .select("order_id", "customer_id", "code"))


def last_purchase(tables) -> DataFrame:
    """Last date each customer bought each product (absent pair = never)."""
    return (orders_with_products(tables)
            .groupBy("customer_id", "product_id")
            .agg(F.max("order_placed_on").alias("last_purchased_on")))


def last_purchase_for(tables, pairs: DataFrame) -> DataFrame:
    """O6 for requested (customer_id, product_id) pairs; NULL when never bought.
    Order lines are cut to the requested pairs before aggregating."""
    lines = cut_to_keys(orders_with_products(tables), pairs, ["customer_id", "product_id"])
    last = lines.groupBy("customer_id", "product_id").agg(F.max("order_placed_on").alias("last_purchased_on"))
    return pairs.join(last, ["customer_id", "product_id"], "left")


def discount_validation(codes: DataFrame) -> DataFrame:
    """Per code, ``valid = number_of_uses <> 0 AND active`` (negative = unlimited)."""
    return codes.select("id", "code",
                        ((F.col("number_of_uses") != 0) & F.col("active")).alias("valid"),
                        (F.col("percent_bp") / F.lit(100)).alias("percent"),
                        "stackable")


def request_codes(requests: DataFrame, code_cols=("code_1", "code_2")) -> DataFrame:
    """Collect a request's code columns into one list, skipping NULLs."""
    arr = F.filter(F.array(*[F.col(c) for c in code_cols]), lambda x: x.isNotNull())
    return requests.withColumn("codes", arr)


def discount_set_check(requests: DataFrame, codes: DataFrame, strict: bool = False) -> DataFrame:
    """Judge each request's list of codes (``request_id``, ``codes`` ARRAY<STRING>).

    Drop repeats, look each code up, drop unknown ones; accept only if the
    known count equals the *raw* list length (so a repeated code fails) and, if
    more than one is known, all are stackable. ``valid`` is not consulted
    unless ``strict``. An empty list is accepted.
    """
    per_code = (requests.select("request_id", F.size("codes").cast("bigint").alias("n_raw"),
                                F.explode_outer(F.array_distinct("codes")).alias("code")))
    c = codes.select("code", F.lit(True).alias("_known"), "stackable", "percent_bp",
                     ((F.col("number_of_uses") != 0) & F.col("active")).alias("_valid"),
                     F.col("id").alias("discount_code_id"))
    j = per_code.join(c, "code", "left")
    agg = j.groupBy("request_id", "n_raw").agg(
        F.count("_known").alias("n_known"),
        F.coalesce(F.bool_and(F.when(F.col("_known"), F.col("stackable"))), F.lit(True)).alias("_all_stack"),
        F.coalesce(F.bool_and(F.when(F.col("_known"), F.col("_valid"))), F.lit(True)).alias("_all_valid"),
        F.coalesce(F.sum("percent_bp"), F.lit(0)).alias("percent_bp_total"),
    )
    ok = (F.col("n_known") == F.col("n_raw")) & ((F.col("n_known") <= 1) | F.col("_all_stack"))
    if strict:
        ok = ok & F.col("_all_valid")
    return agg.select("request_id", "n_raw", "n_known", ok.alias("codes_accepted"), "percent_bp_total")


def basket_check(tables, as_of, customer_id: int | None = None) -> DataFrame:
    """Each basket line with ``available = quantity <= stock AND available``
    (three-valued: NULL stock or flag gives NULL) and the unit price. The catalogue,
    stock and price log are first cut to the baskets' products."""
    b = tables.products_in_basket
    if customer_id is not None:
        b = b.where(F.col("customer_id") == F.lit(customer_id))
    c = cat.product_catalog(tables, as_of, ids=b).select(
        F.col("id").alias("product_id"), F.col("stock_count"), F.col("available").alias("_flag"), "price_cents")
    return (b.join(c, "product_id", "left")
            .select("customer_id", "product_id", "quantity",
                    ((F.col("quantity") <= F.col("stock_count")) & F.col("_flag")).alias("available"),
                    "price_cents",
                    cents_to_amount(F.col("price_cents")).alias("price_per_item")))


def basket_verdict(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Per customer, the basket is valid unless a line is exactly FALSE
    (NULL passes, as in the reference; ``strict`` rejects NULL too). Customers
    without lines are not listed; callers treat absence as an empty basket."""
    bad = F.coalesce(~F.col("available"), F.lit(strict))
    return (checked.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.bool_or(bad).alias("_has_bad"))
            .select("customer_id", "n_lines", (~F.col("_has_bad")).alias("basket_valid")))


def order_pricing(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Per customer, ``total = sum(price * qty)`` (NULL price counts 0)."""
    return (checked.groupBy("customer_id")
            .agg(F.sum(F.coalesce(F.col("price_cents"), F.lit(0)) * F.col("quantity")).alias("total_cents")))


def discounted_total(total_cents, percent_bp_total, strict: bool = False):
    """O11 discount: each percent off the *original* total, no floor unless strict."""
    v = apply_percent_off(total_cents, percent_bp_total)
    return F.greatest(v, F.lit(0)) if strict else v


def stock_after(stock: DataFrame, ordered_lines: DataFrame) -> DataFrame:
    """``amount - ordered quantity`` per product, no floor; products
    without a stock row stay without one."""
    used = ordered_lines.groupBy("product_id").agg(F.sum("quantity").alias("_used"))
    return (stock.join(used, "product_id", "left")
            .select("product_id", (F.col("amount") - F.coalesce("_used", F.lit(0))).alias("amount")))


def discount_uses_after(codes: DataFrame, code_links: DataFrame) -> DataFrame:
    """Minus one use per order while ``number_of_uses > 0``; zero and
    negative (unlimited) are unchanged."""
    used = code_links.groupBy("discount_code_id").agg(F.count(F.lit(1)).alias("_uses"))
    n = F.col("number_of_uses")
    return (codes.join(used, codes.id == used.discount_code_id, "left")
            .select(*[c for c in codes.columns if c != "number_of_uses"],
                    F.when(n > 0, F.greatest(n - F.coalesce("_uses", F.lit(0)), F.lit(0))).otherwise(n)
                    .alias("number_of_uses"))
            .select(*codes.columns))
