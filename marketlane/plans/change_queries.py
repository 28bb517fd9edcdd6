"""Registered keyed-change queries (W instances, B2, V3/V4/V7, R1-R4, Q5/Q6,
A3/A4/A8, I2/I4, O17).

Each builds a change batch from the driver tables (stand-in input: rows in the
schema the operator expects, the operator does all the work) and returns the
outcome per change or the changed table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as acc
from ..operators import admin
from ..operators import basket as bk
from ..operators import community as com
from ..operators import history as hist
from ..operators import images as img
from ..session import materialize
from .registry import AS_OF, register


def _k(props="props"):
    return F.regexp_extract(F.col(props), r"[0-9]+", 0).cast("bigint")


# ---- brands and types ---------------------------------------------------------

@register("brand_create")
def q_brand_create(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"),
                          F.concat(F.lit("  Brand#"), F.col("p_size").cast("string"), F.lit(" ")).alias("name"))
    return admin.create_brands(t, batch).outcomes


def _brand_renames(t):
    return t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 30).cast("bigint").alias("id"),
                         F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("name"))


@register("brand_rename")
def q_brand_rename(t):
    return admin.rename_brands(t, _brand_renames(t)).outcomes


@register("brand_rename_table")
def q_brand_rename_table(t):
    return admin.rename_brands(t, _brand_renames(t)).table


@register("brand_delete")
def q_brand_delete(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), F.col("p_size").cast("bigint").alias("id"))
    return admin.delete_brands(t, batch).outcomes


def _brand_deletes(t):
    return t.part.select(F.col("p_partkey").alias("seq"), F.col("p_size").cast("bigint").alias("id"))


@register("brand_delete_restrict")
def q_brand_delete_restrict(t):
    return admin.delete_catalogue_rows(t, "brands", _brand_deletes(t), "restrict").outcomes


@register("brand_delete_cascade")
def q_brand_delete_cascade(t):
    """The catalogue's own rules: a brand's products go with it unless ordered or in a basket."""
    return admin.delete_catalogue_rows(t, "brands", _brand_deletes(t)).outcomes


@register("brand_delete_cascade_prices")
def q_brand_delete_cascade_prices(t):
    """The prices that are left when everything that refers to a deleted brand goes."""
    return admin.delete_catalogue_rows(t, "brands", _brand_deletes(t).where("id > 10"), "cascade").tables["product_prices"]


def _base_deletes(t):
    return t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 200).cast("bigint").alias("id"))


@register("base_product_delete_restrict")
def q_base_product_delete_restrict(t):
    return admin.delete_catalogue_rows(t, "base_products", _base_deletes(t), "restrict").outcomes


@register("base_product_delete_cascade")
def q_base_product_delete_cascade(t):
    return admin.delete_catalogue_rows(t, "base_products", _base_deletes(t)).outcomes


@register("product_type_create")
def q_product_type_create(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"),
                          F.concat(F.lit(" "), F.upper(F.split("p_name", " ")[1])).alias("type"))
    return admin.create_product_types(t, batch).outcomes


@register("product_type_rename")
def q_product_type_rename(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 8).cast("bigint").alias("id"),
                          F.upper(F.split("p_name", " ")[0]).alias("type"))
    return admin.rename_product_types(t, batch).outcomes


@register("product_type_delete")
def q_product_type_delete(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 9).cast("bigint").alias("id"))
    return admin.delete_product_types(t, batch).outcomes


# ---- base products ------------------------------------------------------------

@register("base_product_create")
def q_base_product_create(t):
    s = F.col("s_suppkey")
    batch = t.supplier.select(
        (s + 1).alias("seq"), F.concat(F.col("s_name"), F.lit(" line")).alias("description"),
        F.col("s_nationkey").alias("brand_id"),
        F.array((s % 7 + 1).cast("bigint"), ((s + 2) % 7 + 1).cast("bigint")).alias("type_ids"))
    _tables, verdicts = admin.create_base_products(t, batch)
    return verdicts.select(F.col("group_id").alias("seq"), "outcome")


@register("base_product_delete")
def q_base_product_delete(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 200).cast("bigint").alias("id"))
    return admin.delete_base_products(t, batch).outcomes


def _brand_sets(t):
    return t.part.select(
        F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 160).cast("bigint").alias("id"),
        F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("bigint").alias("brand_id"))


@register("base_product_set_brand")
def q_base_product_set_brand(t):
    return admin.set_base_product_brands(t, _brand_sets(t)).outcomes


@register("base_product_set_brand_table")
def q_base_product_set_brand_table(t):
    return admin.set_base_product_brands(t, _brand_sets(t)).table.select("id", "description", "brand_id")


@register("base_product_description")
def q_base_product_description(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 170).cast("bigint").alias("id"),
                          F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("description"))
    return admin.set_base_product_descriptions(t, batch).outcomes


@register("assign_types")
def q_assign_types(t):
    batch = t.part.select(
        F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 150 + 1).alias("product_id"),
        F.array((F.col("p_size") % 7 + 1).cast("bigint"), ((F.col("p_size") + 3) % 7 + 1).cast("bigint")).alias("type_ids"))
    _tables, verdicts = admin.assign_types(t, batch)
    return verdicts.select(F.col("group_id").alias("seq"), "outcome")


@register("unassign_types")
def q_unassign_types(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 150 + 1).cast("bigint").alias("product_id"),
                          (F.col("p_size") % 7 + 1).cast("bigint").alias("type_id"))
    return admin.unassign_types(t, batch).outcomes


# ---- products, prices, order status ---------------------------------------------

@register("product_create")
def q_product_create(t):
    batch = t.part.select(
        (F.col("p_partkey") + 1).alias("seq"), F.concat(F.col("p_name"), F.lit(" mk2")).alias("name"),
        F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")).alias("description"),
        (F.col("p_partkey") % 170 + 1).alias("base_product_id"), F.col("p_size").alias("amount"),
        F.col("p_retailprice").alias("price"))
    _tables, verdicts = admin.create_products(t, batch, AS_OF)
    return verdicts.select(F.col("group_id").alias("seq"), "outcome")


@register("product_rename")
def q_product_rename(t):
    batch = t.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") * 3).alias("id"),
                          F.upper("p_name").alias("name"))
    return admin.rename_products(t, batch).outcomes


def _descriptions(t):
    return t.part.select(
        F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 2500).alias("id"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("  New "), F.col("p_name"))).alias("description"))


@register("product_description")
def q_product_description(t):
    return admin.set_product_descriptions(t, _descriptions(t)).outcomes


@register("product_description_table")
def q_product_description_table(t):
    return admin.set_product_descriptions(t, _descriptions(t)).table


@register("price_set")
def q_price_set(t):
    """The whole price change log at a higher price, half of it a day later, upserted
    into the price table: rows are replaced, added and kept."""
    log = t.price_change_log.withColumn("seq", F.col("seq_order")).withColumn("price_cents", F.col("price_cents") + 100)
    log = log.withColumn("date_active_from", F.date_add("date_active_from", (F.col("seq_order") % 2).cast("int")))
    return admin.set_prices(t, log, order_cols=["seq_order", "seq_line", "price_cents"]).table


@register("order_status_update")
def q_order_status_update(t):
    batch = t.orders.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") + 1).alias("id"),
                            F.substr(F.col("o_orderpriority"), F.lit(1), F.lit(1)).cast("bigint").alias("status_id"))
    return admin.set_order_statuses(t, batch).outcomes


# ---- basket -------------------------------------------------------------------

@register("basket_contents")
def q_basket_contents(t):
    return bk.basket_contents(t)


def _basket_log(t):
    return t.basket_events.select(F.col("event_id").alias("seq"), "customer_id", "product_id", "op", "quantity")


@register("basket_change_filter")
def q_basket_change_filter(t):
    return bk.basket_change_filter(_basket_log(t)).select("seq", "op", "quantity",
                                                          F.col("_b_valid").alias("valid"))


@register("basket_fold")
def q_basket_fold(t):
    return bk.basket_fold(t.products_in_basket, _basket_log(t), t.products, t.customer_accounts).outcomes


@register("basket_fold_basket")
def q_basket_fold_basket(t):
    return bk.basket_fold(t.products_in_basket, _basket_log(t), t.products, t.customer_accounts).basket


# ---- view history and favourites -----------------------------------------------

def _later_views(t):
    """Every view event, none, one or two days later: a third repeats the history."""
    return t.view_events.withColumnRenamed("event_id", "seq").withColumn("ts", F.col("ts") + F.make_dt_interval((F.col("seq") % 3).cast("int")))


@register("record_views")
def q_record_views(t):
    return hist.record_views(t, _later_views(t)).outcomes


@register("record_views_table")
def q_record_views_table(t):
    return hist.record_views(t, _later_views(t)).table


def _event_pairs(t):
    return t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("customer_id"),
                           _k().alias("product_id"))


@register("remove_views")
def q_remove_views(t):
    return hist.remove_views(t, _event_pairs(t)).outcomes


@register("favourite_set")
def q_favourite_set(t):
    return hist.set_favourites(t, _event_pairs(t)).outcomes


@register("favourite_remove")
def q_favourite_remove(t):
    return hist.remove_favourites(t, _event_pairs(t)).outcomes


# ---- reviews ----------------------------------------------------------------------

def _submissions(t):
    """The submissions with a unique order: the fixture's ``seq`` repeats (line
    items repeat order and line number), so ties get their rank among the
    repeated rows (tiny groups) appended, in as many places as the largest
    group needs (100 at least)."""
    from pyspark.sql import Window

    s = materialize(t.review_submissions)       # counted, then numbered
    w = Window.partitionBy("seq").orderBy("customer_id", "product_id", "rating", "review", "created_on")
    stride = s.groupBy("seq").count().select(F.greatest(F.max("count"), F.lit(100)).alias("_m")).scalar()
    return materialize(s.withColumn("seq", F.col("seq") * stride + F.row_number().over(w) - 1))


def _reviews(t, submissions):
    return com.review_intake(t, com.empty_reviews(t.spark), submissions)


def _earlier_reviews(submissions):
    """A table of reviews that some of the submitting customers have written before."""
    first = submissions.groupBy("customer_id", "product_id").agg(F.min("seq").alias("id")).where(F.col("id") % 2 == 1)
    return first.select("id", "customer_id", "product_id", F.lit(5).cast("bigint").alias("rating"), F.lit("before").alias("text"),
                        F.lit("1990-01-01").cast("date").alias("created_on"), F.lit(None).cast("date").alias("updated_on"))


@register("review_intake")
def q_review_intake(t):
    submissions = _submissions(t)
    return com.review_intake(t, materialize(_earlier_reviews(submissions)), submissions).outcomes.select("seq", "customer_id", "product_id", "id", "outcome")


@register("product_reviews")
def q_product_reviews(t):
    return com.product_reviews(_reviews(t, _submissions(t)).table)


@register("review_updates")
def q_review_updates(t):
    s = _submissions(t)
    batch = s.select("seq", (F.col("seq") - F.col("seq") % 1000 + 100).alias("id"), "customer_id",
                     (F.col("rating") + 1).alias("rating"), F.concat(F.col("review"), F.lit(" (edited)")).alias("review"))
    return com.review_updates(_reviews(t, s).table, batch, AS_OF).outcomes.select("seq", "id", "customer_id", "outcome")


@register("review_deletes")
def q_review_deletes(t):
    s = _submissions(t)
    batch = s.select("seq", (F.col("seq") - F.col("seq") % 1000 + 200).alias("id"),
                     F.when(F.col("seq") % 3 == 0, F.col("customer_id") + 1).otherwise(F.col("customer_id"))
                     .alias("customer_id"))
    return com.review_deletes(_reviews(t, s).table, batch).outcomes


# ---- answer ratings, questions, answers ------------------------------------------

def _votes(t):
    return t.events.select(F.col("event_id").alias("seq"), (_k() * 1000 + 1).alias("answer_id"),
                           F.col("user_id").alias("customer_id"), (F.col("value") >= 20).alias("helpful"))


@register("answer_rating_add")
def q_answer_rating_add(t):
    return com.rate_answers(t, _votes(t)).outcomes


@register("answer_rating_change")
def q_answer_rating_change(t):
    return com.change_answer_ratings(t, _votes(t)).outcomes


@register("answer_rating_remove")
def q_answer_rating_remove(t):
    return com.withdraw_answer_ratings(t, _votes(t)).outcomes


def _conv(t, role):
    """Every turn of a role: users ask, assistants answer."""
    return t.conversations.where(F.col("role") == role)


@register("question_ask")
def q_question_ask(t):
    c = _conv(t, "user")
    batch = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("conv_id") % 2500).alias("product_id"),
                     (F.col("conv_id") % 1600).alias("asked_by"), F.col("text").alias("question"))
    return com.ask_questions(t, batch).outcomes.select("seq", "product_id", "asked_by", "id", "outcome")


@register("question_edit")
def q_question_edit(t):
    c = _conv(t, "user")
    batch = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("conv_id") + 1).alias("id"),
                     F.col("text").alias("question"))
    return com.edit_questions(t, batch).outcomes.select("seq", "id", "outcome")


@register("question_delete")
def q_question_delete(t):
    c = _conv(t, "assistant")
    batch = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("conv_id") * 2).alias("id"))
    return com.delete_questions(t, batch).outcomes


@register("answer_insert")
def q_answer_insert(t):
    c = _conv(t, "assistant")
    batch = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").alias("question_id"),
                     (F.col("conv_id") % 20).alias("answered_by"), F.col("text").alias("answer"))
    return com.answer_questions(t, batch).outcomes.select("seq", "question_id", "answered_by", "id", "outcome")


# ---- addresses and accounts --------------------------------------------------------

@register("address_create")
def q_address_create(t):
    c = F.col("c_custkey")
    batch = t.customer.select(
        c.alias("seq"), c.alias("customer_id"), F.concat(F.lit("C"), (c % 100).cast("string")).alias("area_code"),
        F.concat(F.col("c_name"), F.lit(" Street")).alias("first_address_line"),
        F.lit(None).cast("string").alias("second_address_line"), F.col("c_mktsegment").alias("state"),
        F.col("c_nationkey").alias("country_id"))
    return acc.create_addresses(t, batch).outcomes.select("seq", "customer_id", "country_id", "id", "outcome")


@register("address_delete")
def q_address_delete(t):
    c = F.col("c_custkey")
    batch = t.customer.select(c.alias("seq"), (c * 10 + c % 2).alias("id"),
                              F.when(c % 5 == 0, c + 1).otherwise(c).alias("customer_id"))
    return acc.delete_addresses(t, batch).outcomes


@register("default_address_set")
def q_default_address_set(t):
    batch = t.shipping_addresses.select(F.col("id").alias("seq"), "customer_id",
                                        F.col("id").alias("shipping_address_id"))
    return acc.set_default_addresses(t, batch).outcomes


@register("default_address_change")
def q_default_address_change(t):
    batch = t.shipping_addresses.select(F.col("id").alias("seq"), "customer_id",
                                        (F.col("id") + 1).alias("shipping_address_id"))
    return acc.change_default_addresses(t, batch).outcomes


@register("default_address_delete")
def q_default_address_delete(t):
    batch = t.customer.select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 1000).alias("customer_id"))
    return acc.delete_default_addresses(t, batch).outcomes


@register("account_intake")
def q_account_intake(t):
    c = F.col("c_custkey")
    email = F.when(c % 9 == 0, F.concat(F.lower(F.col("c_mktsegment")), F.lit(".shop.example.com"))).otherwise(
        F.concat(F.lit(" "), F.lower(F.col("c_mktsegment")), F.lit("."), (c % 50).cast("string"),
                 F.lit("@shop.example.com ")))
    batch = t.customer.select((c + 1).alias("seq"), email.alias("email"),
                              F.lit("customer_accounts").alias("account_table"))
    _tables, out = acc.account_intake(t, batch)
    return out


# ---- images ------------------------------------------------------------------------

@register("image_register")
def q_image_register(t):
    k = F.col("page_id")
    ext = (F.when(k % 5 == 0, ".png").when(k % 5 == 1, ".jpg").when(k % 5 == 2, ".jpeg")
           .when(k % 5 == 3, ".PNG").otherwise(".gif"))
    batch = t.pages.select(k.alias("seq"), (k % 25).alias("product_id"),
                           F.concat(F.lit("upload-"), (k % 120).cast("string"), ext).alias("source"))
    return img.register_images(t, batch).outcomes


@register("image_drop")
def q_image_drop(t):
    batch = t.pages.select(F.col("page_id").alias("seq"), (F.col("page_id") * 2).alias("id"))
    res, _returned = img.drop_images(t, batch)
    return res.outcomes


@register("image_drop_returned")
def q_image_drop_returned(t):
    batch = t.pages.select(F.col("page_id").alias("seq"), (F.col("page_id") * 2).alias("id"))
    _res, returned = img.drop_images(t, batch)
    return returned


def _sort_requests(t):
    k = F.col("page_id")
    ids = F.when(k % 3 == 0, F.array(k, k + 1)).otherwise(F.array(k + 40, k, k + 20))
    return t.pages.select(k.alias("seq"), (k % 20).alias("product_id"), ids.alias("image_ids"))


@register("image_sort_order")
def q_image_sort_order(t):
    return img.image_sort_order(t, _sort_requests(t)).outcomes.select("seq", "product_id", "outcome")


@register("image_sort_order_table")
def q_image_sort_order_table(t):
    return img.image_sort_order(t, _sort_requests(t)).table
