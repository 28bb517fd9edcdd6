"""Registered order queries."""

from __future__ import annotations

from ..operators import orders as o
from .registry import AS_OF, register


@register("orders_with_products")
def q_orders_with_products(t):
    return o.orders_with_products(t)


@register("order_history")
def q_order_history(t):
    return o.order_history(t)


@register("order_details")
def q_order_details(t):
    return o.order_details(t)


@register("order_products")
def q_order_products(t):
    return o.order_products(t, AS_OF)


@register("order_discounts")
def q_order_discounts(t):
    return o.order_discounts(t)


@register("last_purchase")
def q_last_purchase(t):
    return o.last_purchase(t)


@register("discount_validation")
def q_discount_validation(t):
    return o.discount_validation(t.discount_codes)
