"""Shop tables derived from the driver tables (definitions in FIXTURES.md).

These build stand-in inputs only: they give rows in the schema the operators
expect and do none of the operators' work. Each is a plain DataFrame plan over
the driver scans. Windows without a partition key appear only after a DISTINCT
over a tiny domain (types, statuses, segments), so they stay one small task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUILDERS: dict = {}


def _fixture(fn):
    BUILDERS[fn.__name__] = fn
    return fn


def _first_number(props: str) -> Column:
    return F.regexp_extract(F.col(props), r"[0-9]+", 0).cast("bigint")


def _brand_number(col: str) -> Column:
    return F.substr(F.col(col), F.lit(7)).cast("bigint")


@_fixture
def brands(t) -> DataFrame:
    return (t.part.select(_brand_number("p_brand").alias("id"), F.col("p_brand").alias("name"))
            .distinct())


@_fixture
def product_types(t) -> DataFrame:
    kinds = t.part.select(F.col("p_type").alias("type")).distinct()
    return kinds.select(F.row_number().over(Window.orderBy("type")).cast("bigint").alias("id"), "type")


@_fixture
def base_products(t) -> DataFrame:
    pairs = t.part.select("p_brand", "p_type").distinct()
    return pairs.select(
        F.row_number().over(Window.orderBy("p_brand", "p_type")).cast("bigint").alias("id"),
        F.concat(F.col("p_brand"), F.lit(" "), F.lower("p_type")).alias("description"),
        F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(_brand_number("p_brand"))
        .cast("bigint").alias("brand_id"),
        "p_brand", "p_type",
    )


@_fixture
def assigned_product_type(t) -> DataFrame:
    b = t.base_products.alias("b")
    ty = t.product_types.alias("t")
    joined = b.join(ty, F.col("t.type") == F.col("b.p_type"))
    first = joined.select(F.col("b.id").alias("product_id"), F.col("t.id").alias("type_id"))
    second = (joined.where(F.col("b.id") % 2 == 0)
              .select(F.col("b.id").alias("product_id"), (F.col("t.id") % 6 + 1).cast("bigint").alias("type_id")))
    return first.unionAll(second)


@_fixture
def products(t) -> DataFrame:
    p = t.part.alias("p")
    b = t.base_products.alias("b")
    return (p.join(b, (F.col("b.p_brand") == F.col("p.p_brand")) & (F.col("b.p_type") == F.col("p.p_type")))
            .select(
                F.col("p.p_partkey").alias("id"),
                F.col("p.p_name").alias("name"),
                F.when(F.col("p.p_partkey") % 5 == 0, F.lit(None))
                .otherwise(F.concat(F.lit("A "), F.col("p.p_name"))).alias("description"),
                F.col("b.id").alias("base_product_id"),
                (F.col("p.p_partkey") % 200 != 0).alias("available"),
            ))


@_fixture
def product_stock_levels(t) -> DataFrame:
    # Every product has a row; the amount of some is unknown, of some 0.
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 97 != 0, (F.col("p_size").cast("bigint") - 1) * 50).alias("amount"))


def _unit_price_cents() -> Column:
    return F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint")


@_fixture
def price_change_log(t) -> DataFrame:
    return t.lineitem.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("date_active_from"),
        _unit_price_cents().alias("price_cents"),
        F.col("l_orderkey").alias("seq_order"),
        F.col("l_linenumber").alias("seq_line"),
    )


@_fixture
def product_prices(t) -> DataFrame:
    # Last change per (product, day) by (seq_order, seq_line, price): an aggregate,
    # not a window, so a hot product-day is combined map-side.
    return (t.price_change_log.groupBy("product_id", "date_active_from")
            .agg(F.max_by("price_cents", F.struct("seq_order", "seq_line", "price_cents")).alias("price_cents")))


@_fixture
def customer_accounts(t) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("account_id"))


@_fixture
def staff_accounts(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("id"),
        (F.lit(1000000) + k).alias("account_id"),
        F.when(k % 4 == 0, "sale_accounts").when(k % 4 == 1, "admin_accounts")
        .when(k % 4 == 2, "support_accounts").otherwise("warehouse_accounts").alias("account_table"),
    )


@_fixture
def accounts(t) -> DataFrame:
    cust = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 17 == 0, F.lower("c_name"))
        .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .alias("email"),
    )
    staff = t.supplier.select(
        (F.lit(1000000) + F.col("s_suppkey")).alias("id"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))), F.lit("@staff.example.com")).alias("email"),
    )
    return cust.unionAll(staff)


@_fixture
def shipping_countries(t) -> DataFrame:
    return (t.nation.where(F.col("n_regionkey") != 4)
            .select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")))


@_fixture
def shipping_addresses(t) -> DataFrame:
    c = F.col("c_custkey")
    # Every customer has an address; that of some is not the one their checkout names.
    first = t.customer.select(
        F.when(c % 13 == 0, c * 10 + 5).otherwise(c * 10).alias("id"), c.alias("customer_id"),
        F.concat(F.lit("A"), (c % 100).cast("string")).alias("area_code"),
        F.col("c_name").alias("first_address_line"),
        F.lit(None).cast("string").alias("second_address_line"),
        F.col("c_mktsegment").alias("state"),
        F.col("c_nationkey").cast("bigint").alias("country_id"),
    )
    second = t.customer.where(c % 3 == 0).select(
        (c * 10 + 1).alias("id"), c.alias("customer_id"),
        F.concat(F.lit("B"), (c % 100).cast("string")).alias("area_code"),
        F.col("c_name").alias("first_address_line"),
        F.lit("Flat 2").alias("second_address_line"),
        F.col("c_mktsegment").alias("state"),
        F.col("c_nationkey").cast("bigint").alias("country_id"),
    )
    return first.unionAll(second)


@_fixture
def default_shipping_address(t) -> DataFrame:
    return (t.shipping_addresses.where(F.col("customer_id") % 2 == 0)
            .groupBy("customer_id").agg(F.max("id").alias("shipping_address_id")))


@_fixture
def order_statuses(t) -> DataFrame:
    kinds = t.orders.select(F.col("o_orderstatus").alias("status")).distinct()
    return kinds.select(F.row_number().over(Window.orderBy("status")).cast("bigint").alias("id"), "status")


@_fixture
def shop_orders(t) -> DataFrame:
    o = t.orders.alias("o")
    s = t.order_statuses.alias("s")
    return (o.join(s, F.col("s.status") == F.col("o.o_orderstatus"))
            .select(
                F.col("o.o_orderkey").alias("id"),
                F.col("o.o_custkey").alias("customer_id"),
                F.when(F.col("o.o_orderkey") % 50 == 0, F.lit(None)).otherwise(F.col("s.id")).alias("status_id"),
                (F.col("o.o_custkey") * 10).alias("shipping_address_id"),
                F.round(F.col("o.o_totalprice") * 100).cast("bigint").alias("price_paid_cents"),
                F.col("o.o_orderdate").alias("placed_on"),
            ))


@_fixture
def product_orders(t) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        _unit_price_cents().alias("price_cents"),
    )


@_fixture
def discount_codes(t) -> DataFrame:
    pct = t.lineitem.select(F.round(F.col("l_discount") * 100).cast("bigint").alias("pct")).distinct()
    p = F.col("pct")
    return pct.select(
        (p + 1).alias("id"),
        F.concat(F.lit("D"), p.cast("string")).alias("code"),
        (p * 100).alias("percent_bp"),
        F.when(p % 4 == 0, F.lit(-1)).when(p % 4 == 1, F.lit(0)).otherwise(p * 100).cast("bigint").alias("number_of_uses"),
        (p % 5 != 0).alias("active"),
        (p % 3 != 0).alias("stackable"),
    )


@_fixture
def discount_codes_for_order(t) -> DataFrame:
    return (t.lineitem.select(F.col("l_orderkey").alias("order_id"),
                              (F.round(F.col("l_discount") * 100).cast("bigint") + 1).alias("discount_code_id"))
            .distinct())


@_fixture
def products_in_basket(t) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"))
            .agg(F.max(F.col("l_quantity").cast("bigint")).alias("quantity")))


@_fixture
def checkout_requests(t) -> DataFrame:
    c = F.col("customer_id")
    return t.products_in_basket.select("customer_id").distinct().select(
        c.alias("request_id"), c,
        (c * 10).alias("shipping_address_id"),
        F.concat(F.lit("D"), (c % 12).cast("string")).alias("code_1"),
        F.when(c % 4 == 0, F.concat(F.lit("D"), ((c + 3) % 12).cast("string")))
        .when(c % 4 == 1, F.concat(F.lit("D"), (c % 12).cast("string"))).alias("code_2"),
    )


@_fixture
def view_events(t) -> DataFrame:
    return (t.events.where(F.col("event_type") == "view")
            .select("event_id", "ts", F.col("user_id").alias("customer_id"), _first_number("props").alias("product_id")))


@_fixture
def product_view_history(t) -> DataFrame:
    return (t.view_events.select("customer_id", "product_id", F.col("ts").cast("date").alias("date_viewed"))
            .distinct())


@_fixture
def customer_favourite_products(t) -> DataFrame:
    return (t.events.where(F.col("event_type") == "click")
            .select(F.col("user_id").alias("customer_id"), _first_number("props").alias("product_id"))
            .distinct())


@_fixture
def basket_events(t) -> DataFrame:
    et = F.col("event_type")
    return (t.events.where(et != "view").select(
        "event_id", "ts", F.col("user_id").alias("customer_id"),
        (_first_number("props") % 20).alias("product_id"),
        F.when(et == "click", "add").when(et == "signup", "update")
        .when(et == "error", "remove").when(et == "purchase", "clear").alias("op"),
        (F.lit(1) + F.col("event_id") % 5).alias("quantity"),
    ))


@_fixture
def review_submissions(t) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("l_orderkey") % 11 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("product_id"),
        (F.round(F.col("l_discount") * 100) + F.lit(0.5) * (F.col("l_linenumber") % 3)).alias("rating"),
        F.concat(F.lit("review "), F.col("l_returnflag"), F.lit(" "), F.col("l_linenumber").cast("string")).alias("review"),
        F.col("l_shipdate").cast("date").alias("created_on"),
    ))


@_fixture
def product_questions(t) -> DataFrame:
    # A conversation asks with its first user turn, whatever comes before it.
    first = (t.conversations.where(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min_by("text", F.struct("turn", "text")).alias("question")))
    return first.select(
        F.col("conv_id").alias("id"),
        (F.col("conv_id") % 200).alias("product_id"),
        (F.col("conv_id") % 150).alias("asked_by"),
        "question",
    )


@_fixture
def product_question_answers(t) -> DataFrame:
    c = t.conversations
    return (c.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("question_id"),
        (F.col("conv_id") % 10).alias("answered_by"),
        F.col("text").alias("answer"),
    ))


@_fixture
def product_question_answers_rating(t) -> DataFrame:
    votes = (t.events.where(F.col("event_type").isin("click", "view"))
             .select(_first_number("props").alias("k"), F.col("user_id").alias("customer_id"), "event_id", "value"))
    last = (votes.groupBy("k", "customer_id")
            .agg(F.max_by("value", "event_id").alias("value")))
    rated = last.select((F.col("k") * 1000 + 1).alias("answer_id"), "customer_id",
                        (F.col("value") >= 20).alias("helpful"))
    answers = t.product_question_answers.select(F.col("id").alias("answer_id"))
    return rated.join(answers, "answer_id", "left_semi")


@_fixture
def product_images(t) -> DataFrame:
    k = F.col("page_id")
    ext = F.when(k % 4 == 0, ".png").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".jpg").otherwise(".gif")
    return t.pages.select(
        k.alias("id"), (k % 20).alias("product_id"),
        F.concat(F.lit("image-"), k.cast("string"), ext).alias("source"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(k * 7 % 10).cast("bigint").alias("sort_position"),
    )


@_fixture
def filter_categories(t) -> DataFrame:
    seg = t.customer.select(F.col("c_mktsegment").alias("name")).distinct()
    return seg.select(F.row_number().over(Window.orderBy("name")).cast("bigint").alias("id"), "name")
