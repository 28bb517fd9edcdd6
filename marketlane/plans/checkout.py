"""Whole-batch checkout.

For a batch of checkout requests (request_id, customer_id, shipping_address_id,
codes ARRAY<STRING>) this returns a status per request and every table the
checkouts change, as DataFrames of one plan:

1. code list check (O8) -> DISCOUNT_CODE_NOT_EXIST;
2. the address must belong to the customer -> SHIPPING_ADDRESS_INVALID;
3. basket check (O9/O10): invalid when empty or when a line is exactly FALSE
   -> BASKET_INVALID, and each FALSE product is purged (O15) from every
   customer's basket (only the requester's with ``strict``);
4. otherwise an order is written (O16) at the basket's current prices, with
   the discounted total (O11), code uses are decremented (O14), stock is
   reduced (O13) and the customer's basket is cleared.

Batch semantics: every request is judged against the opening tables, which is
what the reference does for any single checkout and for concurrent ones that
read before anyone writes (it takes no row lock). Within one customer the
requests that reach the basket step are taken in ``request_id`` order: the
first is judged on the opening basket; the second sees what the first left
(empty after an order; the opening basket minus the purged products after a
rejection, whose remaining lines are all orderable); any later one finds an
empty basket. "First" and "second" are aggregates per customer, not windows.

New order ids are ``max(id) + request_id``: unique, stable under recomputation,
with gaps as a database sequence has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents_to_amount
from ..functions.outcomes import BASKET_INVALID, DISCOUNT_CODE_NOT_EXIST, OK, SHIPPING_ADDRESS_INVALID
from ..operators import orders as o
from .. import session
from ..sources.sinks import Keyed, write_parts


@dataclass
class CheckoutResult:
    statuses: DataFrame
    orders: DataFrame
    order_lines: DataFrame
    code_links: DataFrame
    stock: DataFrame
    discount_codes: DataFrame
    basket: DataFrame
    basket_removed: DataFrame  # customer_id, product_id of the basket lines that are gone


def _ntz(now) -> "F.Column":
    """A TIMESTAMP_NTZ literal built from text, so no time zone (Python's or the
    session's) can shift it."""
    text = now.isoformat(sep=" ") if hasattr(now, "isoformat") else str(now)
    return F.lit(text).cast("timestamp_ntz")


def checkout_requests_with_codes(tables) -> DataFrame:
    return o.request_codes(tables.checkout_requests).select(
        "request_id", "customer_id", "shipping_address_id", "codes")


def bulk_checkout(tables, requests: DataFrame, as_of, now, strict: bool = False,
                  status_id=None, materialize: bool = True) -> CheckoutResult:
    """Run the checkout plan. With ``materialize`` the two intermediates every
    output reads (the checked basket lines and the per-request verdicts) are
    written once to the shared checkpoint folder (``DataFrame.checkpoint``),
    so the seven outputs do not each recompute the catalogue and the basket
    checks, and a lost executor recomputes from the checkpoint, not from the
    sources."""
    if materialize:
        # The request batch is read by several steps; keep one copy.
        requests = session.materialize(requests)
    codes_check = o.discount_set_check(requests.select("request_id", "codes"), tables.discount_codes, strict)
    addr = tables.shipping_addresses.select(F.col("id").alias("shipping_address_id"), "customer_id",
                                            F.lit(True).alias("_c_addr"))
    r = (requests.join(codes_check, "request_id", "left")
         .join(addr, ["shipping_address_id", "customer_id"], "left"))
    pre = (F.when(~F.coalesce(F.col("codes_accepted"), F.lit(False)), F.lit(DISCOUNT_CODE_NOT_EXIST))
           .when(F.col("_c_addr").isNull(), F.lit(SHIPPING_ADDRESS_INVALID)))
    r = r.withColumn("_c_pre", pre)

    # Basket step: first and second request per customer (aggregates, skew-safe).
    staged = r.where(F.col("_c_pre").isNull()).select("request_id", "customer_id")
    first = staged.groupBy("customer_id").agg(F.min("request_id").alias("_c_first"))
    second = (staged.join(first, "customer_id").where(F.col("request_id") > F.col("_c_first"))
              .groupBy("customer_id").agg(F.min("request_id").alias("_c_second")))

    # Availability and prices are needed for the requesting customers' lines
    # only; the purge below still applies to every basket (by product).
    requesting = requests.select("customer_id").distinct()
    asked = tables.products_in_basket.join(requesting, "customer_id", "left_semi")
    if materialize:
        asked = session.materialize(asked)  # counted, cut to and checked by the basket check
    lines = o.basket_check(tables.with_tables(products_in_basket=asked), as_of)
    if materialize:
        lines = session.materialize(lines)
    verdict = o.basket_verdict(lines, strict)  # customers with at least one line
    first_v = first.join(verdict, "customer_id", "left").select(
        "customer_id", "_c_first", F.coalesce("basket_valid", F.lit(False)).alias("_c_v0"))
    rejected_first = first_v.where(~F.col("_c_v0")).select("customer_id")
    false_lines = lines.where(F.col("available") == F.lit(False)).join(rejected_first, "customer_id", "left_semi")
    if strict:
        purged_pairs = false_lines.select("customer_id", "product_id").distinct()
        after_purge = lines.join(purged_pairs, ["customer_id", "product_id"], "left_anti")
    else:
        purged = false_lines.select("product_id").distinct()
        after_purge = lines.join(purged, "product_id", "left_anti")
    b1_size = after_purge.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_c_b1"))

    ranks = (first_v.join(second, "customer_id", "left").join(b1_size, "customer_id", "left")
             .select("customer_id", "_c_first", "_c_second", "_c_v0",
                     (~F.col("_c_v0") & (F.coalesce("_c_b1", F.lit(0)) > 0)).alias("_c_v1")))
    r = r.join(ranks, "customer_id", "left")
    rid = F.col("request_id")
    basket_status = (F.when(rid == F.col("_c_first"), F.when(F.col("_c_v0"), F.lit(OK)).otherwise(F.lit(BASKET_INVALID)))
                     .when(rid == F.col("_c_second"), F.when(F.col("_c_v1"), F.lit(OK)).otherwise(F.lit(BASKET_INVALID)))
                     .otherwise(F.lit(BASKET_INVALID)))
    r = r.withColumn("status", F.coalesce(F.col("_c_pre"), basket_status))
    r = r.withColumn("_c_from_opening", rid == F.col("_c_first"))
    if materialize:
        r = session.materialize(r)

    # Orders: lines of the basket each OK request saw.
    ok = r.where(F.col("status") == OK).select("request_id", "customer_id", "shipping_address_id", "codes",
                                                "percent_bp_total", "_c_from_opening")
    ok_first = ok.where(F.col("_c_from_opening"))
    ok_second = ok.where(~F.col("_c_from_opening"))
    seen = (lines.join(ok_first.select("request_id", "customer_id"), "customer_id")
            .unionByName(after_purge.join(ok_second.select("request_id", "customer_id"), "customer_id")))
    base_id = tables.shop_orders.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    order_id = (base_id + F.col("request_id")).cast("bigint")
    order_lines = seen.select(order_id.alias("order_id"), "product_id", "quantity", "price_cents")
    totals = seen.groupBy("request_id").agg(
        F.sum(F.coalesce(F.col("price_cents"), F.lit(0)) * F.col("quantity")).alias("_c_total"))
    priced = ok.join(totals, "request_id", "left").withColumn(
        "price_paid_cents", o.discounted_total(F.coalesce("_c_total", F.lit(0)), F.col("percent_bp_total"), strict))
    new_orders = priced.select(order_id.alias("id"), "customer_id", F.lit(status_id).cast("bigint").alias("status_id"),
                               "shipping_address_id", "price_paid_cents",
                               _ntz(now).alias("placed_on"))
    dc = tables.discount_codes.select(F.col("id").alias("discount_code_id"), "code")
    code_links = (ok.select(order_id.alias("order_id"), F.explode(F.array_distinct("codes")).alias("code"))
                  .join(dc, "code").select("order_id", "discount_code_id"))

    statuses = (r.join(priced.select("request_id", "price_paid_cents"), "request_id", "left")
                .select("request_id", "customer_id", "status",
                        F.when(F.col("status") == OK, order_id).alias("order_id"),
                        cents_to_amount(F.col("price_paid_cents")).alias("price_paid")))

    stock = o.stock_after(tables.product_stock_levels, order_lines)
    codes_after = o.discount_uses_after(tables.discount_codes, code_links)
    opening = tables.products_in_basket
    ordered, (purged, on) = ok.select("customer_id").distinct(), (purged_pairs, ["customer_id", "product_id"]) if strict else (purged, ["product_id"])
    basket = opening.join(ordered, "customer_id", "left_anti").join(purged, on, "left_anti").select(*opening.columns)
    pairs = opening.select("customer_id", "product_id")
    removed = pairs.join(ordered, "customer_id", "left_semi").unionByName(pairs.join(purged, on, "left_semi"))
    return CheckoutResult(statuses, new_orders, order_lines, code_links, stock, codes_after, basket, removed)


CHECKOUT_OUTPUTS = ("statuses", "orders", "order_lines", "code_links", "stock", "discount_codes", "basket")


def write_checkout(result: CheckoutResult, root: str, version: int) -> str:
    """Write all checkout outputs as one committed version (``sources.sinks``). New rows
    (statuses, orders, lines, code links) are parts of their own; of stock, discount
    codes and baskets only the buckets are written whose products were ordered, codes
    used, or basket lines removed. The first version writes these tables whole."""
    stock = Keyed(result.stock, ["product_id"], result.order_lines.select("product_id"))
    codes = Keyed(result.discount_codes, ["id"], result.code_links.select(F.col("discount_code_id").alias("id")))
    basket = Keyed(result.basket, ["customer_id", "product_id"], result.basket_removed)
    new = {name: getattr(result, name) for name in ("statuses", "orders", "order_lines", "code_links")}
    return write_parts(root, version, new, {"stock": stock, "discount_codes": codes, "basket": basket})
