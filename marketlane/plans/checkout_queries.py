"""Registered checkout queries (O8-O16 and the composed O12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents_to_amount
from .. import session
from ..operators import catalog as cat
from ..operators import orders as o
from ..operators.allocation import serial_allocation
from .checkout import bulk_checkout, checkout_requests_with_codes
from .registry import AS_OF, NOW, register


@register("discount_set_check")
def q_discount_set_check(t):
    return o.discount_set_check(checkout_requests_with_codes(t), t.discount_codes)


@register("basket_check")
def q_basket_check(t):
    return o.basket_check(t, AS_OF)


@register("basket_verdict")
def q_basket_verdict(t):
    return o.basket_verdict(o.basket_check(t, AS_OF))


@register("order_pricing")
def q_order_pricing(t):
    req = checkout_requests_with_codes(t)
    codes = o.discount_set_check(req, t.discount_codes).select("request_id", "percent_bp_total")
    totals = o.order_pricing(o.basket_check(t, AS_OF))
    return (req.join(codes, "request_id").join(totals, "customer_id", "left")
            .select("request_id", "customer_id",
                    cents_to_amount(F.col("total_cents")).alias("total"),
                    cents_to_amount(o.discounted_total(F.col("total_cents"), F.col("percent_bp_total")))
                    .alias("discounted_total")))


def _serial(t):
    """Every customer's basket as a request, in the order of the customers."""
    c = cat.product_catalog(t, AS_OF).select(F.col("id").alias("product_id"), "available")
    lines = t.products_in_basket.join(c, "product_id", "left")
    return lines.select(F.col("customer_id").alias("request_id"), "product_id", "quantity", "available")


@register("checkout_serial")
def q_checkout_serial(t):
    """Baskets that compete for stock, one at a time: which ones get all they hold."""
    return serial_allocation(_serial(t), t.product_stock_levels).select(F.col("request_id").alias("customer_id"), "allocated")


@register("checkout_serial_stock")
def q_checkout_serial_stock(t):
    """What is left of every product after the baskets that were allocated."""
    lines = session.materialize(_serial(t))
    taken = serial_allocation(lines, t.product_stock_levels).where("allocated")
    return o.stock_after(t.product_stock_levels, lines.join(taken, "request_id", "left_semi"))


def _baskets_once(t):
    """The tables with the stand-in baskets written once: the requests, the checks and the
    outputs all read them."""
    return t.with_tables(products_in_basket=session.materialize(t.products_in_basket))


def _checkout(t):
    t = _baskets_once(t)
    return bulk_checkout(t, checkout_requests_with_codes(t), AS_OF, NOW)


@register("checkout_status")
def q_checkout_status(t):
    return _checkout(t).statuses


@register("checkout_orders")
def q_checkout_orders(t):
    return _checkout(t).orders


@register("checkout_order_lines")
def q_checkout_order_lines(t):
    return _checkout(t).order_lines


@register("checkout_code_links")
def q_checkout_code_links(t):
    return _checkout(t).code_links


@register("checkout_stock")
def q_checkout_stock(t):
    return _checkout(t).stock


@register("checkout_discount_codes")
def q_checkout_discount_codes(t):
    return _checkout(t).discount_codes


@register("checkout_basket")
def q_checkout_basket(t):
    return _checkout(t).basket


@register("checkout_feed_messages")
def q_checkout_feed_messages(t):
    from ..streaming.basket_feed import checkout_messages

    t = _baskets_once(t)
    req = session.materialize(checkout_requests_with_codes(t))
    return checkout_messages(bulk_checkout(t, req, AS_OF, NOW).basket, req)
