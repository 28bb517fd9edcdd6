"""Registered lookup, history, community, account and image reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import accounts as acc
from ..operators import community as com
from ..operators import history as hist
from ..operators import images as img
from ..operators import lookups as lk
from .registry import register

VIEW_DAY = dt.date(2024, 1, 15)

for _name in lk.LOOKUPS:
    register(f"lookup_{_name}")(lambda t, _n=_name: lk.lookup(t, _n))


@register("lookup_brand_by_id")
def q_lookup_brand_by_id(t):
    req = t.base_products.select(F.col("id").alias("base_product_id"), "brand_id")
    return lk.lookup_ids(t, "brands", req, id_col="brand_id")


@register("lookup_product_type_by_id")
def q_lookup_product_type_by_id(t):
    req = t.assigned_product_type.select("product_id", "type_id")
    return lk.lookup_ids(t, "product_types", req, id_col="type_id")


@register("all_product_ids")
def q_all_product_ids(t):
    return lk.all_product_ids(t)


@register("recent_views")
def q_recent_views(t):
    return hist.recent_views(t.product_view_history, 20)


@register("viewed_on_day")
def q_viewed_on_day(t):
    return hist.viewed_on_day(t.product_view_history, t.customer_favourite_products, VIEW_DAY)


@register("favourites")
def q_favourites(t):
    return hist.favourites(t)


@register("has_favourited")
def q_has_favourited(t):
    pairs = t.product_view_history.select("customer_id", "product_id").distinct()
    return hist.has_favourited(pairs, t.customer_favourite_products)


@register("product_questions")
def q_product_questions(t):
    return com.product_questions(t)


@register("helpful_counts")
def q_helpful_counts(t):
    return com.helpful_counts(t.product_question_answers_rating)


@register("answers_ranked")
def q_answers_ranked(t):
    return com.answers_ranked(t)


@register("answer_rating")
def q_answer_rating(t):
    a = t.product_question_answers
    q = t.product_questions
    req = a.join(q, a.question_id == q.id).select(a.id.alias("answer_id"), q.asked_by.alias("customer_id"))
    return com.answer_rating(t, req)


@register("customer_addresses")
def q_customer_addresses(t):
    return acc.customer_addresses(t)


@register("default_addresses")
def q_default_addresses(t):
    return acc.default_addresses(t)


@register("account_types")
def q_account_types(t):
    return acc.account_types(t)


@register("account_lookup")
def q_account_lookup(t):
    emails = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"))
    return acc.account_lookup(t, emails)


@register("account_email")
def q_account_email(t):
    ids = t.product_question_answers.select(F.col("id").alias("answer_id"), F.col("answered_by").alias("account_id"))
    return acc.account_email(t, ids)


@register("email_check")
def q_email_check(t):
    return acc.email_check(t.accounts)


@register("product_images")
def q_product_images(t):
    return img.product_images(t)


@register("image_type_check")
def q_image_type_check(t):
    return img.image_type_check(t.product_images.select("id", "product_id", "source"))
