"""Literal-row cases for edges the generated data does not reach (FIXTURES.md)."""

import datetime as dt

import pytest

from marketlane.operators import catalog as C
from marketlane.operators import community as Q
from marketlane.operators import history as V
from marketlane.operators import images as I
from marketlane.operators import orders as O
from marketlane.operators import search as S
from marketlane.operators.accounts import email_check
from marketlane.plans.checkout import bulk_checkout
from marketlane.sources.tables import ShopTables

D = dt.date


def _t(spark, **frames):
    return ShopTables(spark, "/nonexistent", frames)


CODES = "id bigint, code string, percent_bp bigint, number_of_uses bigint, active boolean, stackable boolean"


def test_discount_validation(spark):
    rows = [(i, f"C{i}", 500, uses, act, True) for i, (uses, act) in
            enumerate([(-1, True), (-1, False), (0, True), (0, False), (1, True), (1, False)])]
    got = {r.code: r.valid for r in O.discount_validation(spark.createDataFrame(rows, CODES)).collect()}
    assert got == {"C0": True, "C1": False, "C2": False, "C3": False, "C4": True, "C5": False}


def test_discount_set_check(spark):
    codes = spark.createDataFrame([
        (1, "S1", 1000, 5, True, True), (2, "S2", 500, -1, True, True),
        (3, "N", 1500, 5, True, False), (4, "X", 500, 0, True, True)], CODES)
    req = spark.createDataFrame([
        (1, []), (2, ["N"]), (3, ["S1", "S2"]), (4, ["S1", "N"]), (5, ["S1", "S1"]), (6, ["Z"]), (7, ["X"])],
        "request_id bigint, codes array<string>")
    got = {r.request_id: r.codes_accepted for r in O.discount_set_check(req, codes).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}
    strict = {r.request_id: r.codes_accepted for r in O.discount_set_check(req, codes, strict=True).collect()}
    assert strict[7] is False and strict[3] is True


def _shop(spark, basket, stock, available=True, prices=None, codes=None):
    products = spark.createDataFrame([(p, f"p{p}", None, 1, available if not isinstance(available, dict)
                                       else available[p]) for p in (1, 2, 3)],
                                     "id bigint, name string, description string, base_product_id int, available boolean")
    return _t(
        spark,
        products=products,
        base_products=spark.createDataFrame([(1, "b", 1, "B", "T")],
                                            "id int, description string, brand_id int, p_brand string, p_type string"),
        brands=spark.createDataFrame([(1, "B")], "id int, name string"),
        product_stock_levels=spark.createDataFrame(stock, "product_id bigint, amount bigint"),
        product_prices=spark.createDataFrame(prices or [(p, D(2000, 1, 1), 100 * p) for p in (1, 2, 3)],
                                             "product_id bigint, date_active_from date, price_cents bigint"),
        products_in_basket=spark.createDataFrame(basket, "customer_id bigint, product_id bigint, quantity bigint"),
        shipping_addresses=spark.createDataFrame(
            [(10, 1, "a", "l1", None, "s", 1), (20, 2, "a", "l1", None, "s", 1)],
            "id bigint, customer_id bigint, area_code string, first_address_line string, "
            "second_address_line string, state string, country_id int"),
        discount_codes=spark.createDataFrame(codes or [(1, "D50", 5000, 2, True, True)], CODES),
        shop_orders=spark.createDataFrame([(100, 1, 1, 10, 0, dt.datetime(2000, 1, 1))],
                                          "id bigint, customer_id bigint, status_id int, shipping_address_id bigint, "
                                          "price_paid_cents bigint, placed_on timestamp_ntz"),
    )


def test_basket_check_three_valued(spark):
    # product 1: quantity == stock -> TRUE; 2: no stock row, flag TRUE -> NULL; 3: no stock, flag FALSE -> FALSE
    t = _shop(spark, [(1, 1, 5), (1, 2, 1), (2, 3, 1)], [(1, 5)], available={1: True, 2: True, 3: False})
    got = {r.product_id: r.available for r in O.basket_check(t, D(2001, 1, 1)).collect()}
    assert got == {1: True, 2: None, 3: False}
    verdict = {r.customer_id: r.basket_valid for r in O.basket_verdict(O.basket_check(t, D(2001, 1, 1))).collect()}
    assert verdict == {1: True, 2: False}
    strict = {r.customer_id: r.basket_valid
              for r in O.basket_verdict(O.basket_check(t, D(2001, 1, 1)), strict=True).collect()}
    assert strict == {1: False, 2: False}


def test_percent_rounding_and_no_floor(spark):
    df = spark.createDataFrame([(3, 5000), (1000, 11000), (0, 5000)], "t bigint, bp bigint")
    got = [r.v for r in df.select(O.discounted_total(df.t, df.bp).alias("v")).collect()]
    assert got == [2, -100, 0]
    floored = [r.v for r in df.select(O.discounted_total(df.t, df.bp, strict=True).alias("v")).collect()]
    assert floored == [2, 0, 0]


def test_order_pricing_null_price_counts_zero(spark):
    lines = spark.createDataFrame([(1, 2, 300), (1, 3, None)], "customer_id bigint, quantity bigint, price_cents bigint")
    assert O.order_pricing(lines).collect()[0].total_cents == 600


def test_discount_uses_after(spark):
    codes = spark.createDataFrame([(1, "A", 100, 2, True, True), (2, "B", 100, -1, True, True),
                                   (3, "C", 100, 0, True, True)], CODES)
    links = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (10, 2), (11, 3)], "order_id bigint, discount_code_id bigint")
    got = {r.code: r.number_of_uses for r in O.discount_uses_after(codes, links).collect()}
    assert got == {"A": 0, "B": -1, "C": 0}


def test_purge_hits_every_basket_and_empty_basket_is_invalid(spark):
    # Both customers hold product 1 (stock 1); customer 1 wants 5 -> FALSE -> purge from both.
    t = _shop(spark, [(1, 1, 5), (2, 1, 1), (2, 2, 1)], [(1, 1), (2, 9), (3, 9)])
    req = spark.createDataFrame([(1, 1, 10, []), (3, 3, 30, [])],
                                "request_id bigint, customer_id bigint, shipping_address_id bigint, codes array<string>")
    res = bulk_checkout(t, req, D(2001, 1, 1), dt.datetime(2001, 1, 1), materialize=False)
    st = {r.request_id: r.status for r in res.statuses.collect()}
    assert st == {1: "BASKET_INVALID", 3: "SHIPPING_ADDRESS_INVALID"}
    assert sorted((r.customer_id, r.product_id) for r in res.basket.collect()) == [(2, 2)]
    strict = bulk_checkout(t, req, D(2001, 1, 1), dt.datetime(2001, 1, 1), strict=True, materialize=False)
    assert sorted((r.customer_id, r.product_id) for r in strict.basket.collect()) == [(2, 1), (2, 2)]
    # Customer 2 owns address 20 but its basket is empty after a purge? No: it is checked on the opening basket.
    req2 = spark.createDataFrame([(5, 2, 20, ["D50"])],
                                 "request_id bigint, customer_id bigint, shipping_address_id bigint, codes array<string>")
    ok = bulk_checkout(t, req2, D(2001, 1, 1), dt.datetime(2001, 1, 1), materialize=False)
    row = ok.statuses.collect()[0]
    assert row.status == "OK" and row.order_id == 105 and row.price_paid == 1.5
    assert {r.product_id: r.amount for r in ok.stock.collect()} == {1: 0, 2: 8, 3: 9}
    assert [r.number_of_uses for r in ok.discount_codes.collect()] == [1]
    empty = spark.createDataFrame([(6, 1, 10, [])],
                                  "request_id bigint, customer_id bigint, shipping_address_id bigint, codes array<string>")
    t_empty = _shop(spark, [(2, 2, 1)], [(2, 9)])
    assert bulk_checkout(t_empty, empty, D(2001, 1, 1), dt.datetime(2001, 1, 1),
                         materialize=False).statuses.collect()[0].status == "BASKET_INVALID"


def test_second_request_of_a_customer_sees_the_left_basket(spark):
    t = _shop(spark, [(1, 1, 5), (1, 2, 1)], [(1, 1), (2, 9)])
    req = spark.createDataFrame([(1, 1, 10, []), (2, 1, 10, []), (3, 1, 10, [])],
                                "request_id bigint, customer_id bigint, shipping_address_id bigint, codes array<string>")
    res = bulk_checkout(t, req, D(2001, 1, 1), dt.datetime(2001, 1, 1), materialize=False)
    st = {r.request_id: r.status for r in res.statuses.collect()}
    assert st == {1: "BASKET_INVALID", 2: "OK", 3: "BASKET_INVALID"}
    assert [(r.product_id, r.quantity) for r in res.order_lines.collect()] == [(2, 1)]


def test_price_as_of(spark):
    prices = spark.createDataFrame([(1, D(2000, 1, 1), 100), (1, D(2000, 6, 1), 200), (1, D(2001, 1, 1), 300),
                                    (2, D(2002, 1, 1), 900)],
                                   "product_id bigint, date_active_from date, price_cents bigint")
    got = {r.product_id: r.price_cents for r in C.price_as_of(prices, "2001-01-01").collect()}
    assert got == {1: 300}
    got = {r.product_id: r.price_cents for r in C.price_as_of(prices, "2000-12-31").collect()}
    assert got == {1: 200}


def test_same_style(spark):
    t = _shop(spark, [(1, 1, 1)], [(1, 1)])
    cat = C.product_catalog(t, D(2001, 1, 1))
    solo = t.products.where("id = 1").withColumn("base_product_id", C.F.lit(7))
    t2 = t.with_tables(products=solo.unionByName(t.products.where("id <> 1")))
    cat2 = C.product_catalog(t2, D(2001, 1, 1))
    assert [r.id for r in C.products_same_style(cat2, t2.products, 1).collect()] == [1]
    assert C.products_same_style(cat, t.products, 99).count() == 0
    assert sorted(r.id for r in C.products_same_style(cat, t.products, 2).collect()) == [1, 2, 3]


@pytest.mark.parametrize("query,expected", [
    ("red ring", [[S.Term(False, ("red",)), S.Term(False, ("ring",))]]),
    ('"red ring"', [[S.Term(False, ("red", "ring"))]]),
    ("red or ring", [[S.Term(False, ("red",))], [S.Term(False, ("ring",))]]),
    ("red or blue -small", [[S.Term(False, ("red",))], [S.Term(False, ("blue",)), S.Term(True, ("small",))]]),
    ("ring -red", [[S.Term(False, ("ring",)), S.Term(True, ("red",))]]),
    ("  ", []),
    ("unknownword", [[S.Term(False, ("unknownword",))]]),
    ("!!! ...", []),
])
def test_parse_query(query, expected):
    assert S.parse_query(query) == expected


def test_search_literal(spark):
    cat = spark.createDataFrame(
        [(1, "red ring"), (2, "ring red"), (3, "blue ring"), (4, "red red widget"), (5, "ring")], "id bigint, name string")
    for c in ["available", "brand_name", "brand_id", "stock_count", "price", "description"]:
        cat = cat.withColumn(c, C.F.lit(None).cast("string"))

    def ids(q):
        return sorted(r.id for r in S.product_search(cat, q).collect())
    assert ids("red ring") == [1, 2]
    assert ids('"red ring"') == [1]
    assert ids("red or ring") == [1, 2, 3, 4, 5]
    assert ids("ring -red") == [3, 5]
    assert ids("unknownword") == []
    assert ids("!!") == []
    with pytest.raises(ValueError):
        S.product_search(cat, "r")
    ranked = [r.id for r in S.product_search_sorted(cat, "red").collect()]
    assert ranked == [4, 1, 2]
    # batch evaluation agrees with the single-query filter
    qs = spark.createDataFrame([("a", "red ring"), ("b", '"red ring"'), ("c", "red or ring"), ("d", "ring -red"),
                                ("e", "-red"), ("f", "-ring or red"), ("g", "-missing"), ("h", "r"), ("i", "!!")], "query_id string, query string")
    res = S.product_search_batch(cat, qs)
    got = {}
    for r in res.matches.collect():
        got.setdefault(r.query_id, set()).add((r.id, r.rank))
    for qid, q in [("a", "red ring"), ("b", '"red ring"'), ("c", "red or ring"), ("d", "ring -red")]:
        assert got.get(qid, set()) == {(r.id, r.rank) for r in S.product_search(cat, q).collect()}
    assert sorted((r.query_id, r.complement, r.excluded_id) for r in res.complement.where("query_id <> 'g'").collect()) == [
        ("e", True, 1), ("e", True, 2), ("e", True, 4), ("f", True, 3), ("f", True, 5)]
    assert [(r.query_id, r.excluded_id) for r in res.complement.where("query_id = 'g'").collect()] == [("g", None)]
    assert sorted((r.query_id, r.reason) for r in res.rejected.collect()) == [("h", "too_short"), ("i", "no_words")]
    for qid, q in [("e", "-red"), ("f", "-ring or red")]:
        shut = {r.excluded_id for r in res.complement.where(C.F.col("query_id") == qid).collect()}
        assert ids(q) == sorted({1, 2, 3, 4, 5} - shut)


def test_search_and_binds_tighter_than_or(spark):
    cat = spark.createDataFrame([(1, "red small hat"), (2, "blue small hat"), (3, "blue hat"), (4, "red hat"), (5, "green hat")],
                                "id bigint, name string")
    for c in ["available", "brand_name", "brand_id", "stock_count", "price", "description"]:
        cat = cat.withColumn(c, C.F.lit(None).cast("string"))
    qs = {"red or blue -small": [1, 3, 4], "blue -small or red": [1, 3, 4], '"red small" or blue hat': [1, 2, 3], "hat -small -green": [3, 4]}
    res = S.product_search_batch(cat, spark.createDataFrame([(q, q) for q in qs], "query_id string, query string"))
    got = {}
    for r in res.matches.collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, want in qs.items():
        assert sorted(r.id for r in S.product_search(cat, q).collect()) == want
        assert sorted(got[q]) == want


def test_recent_views_limits(spark):
    h = spark.createDataFrame([(1, 7, D(2024, 1, d)) for d in (1, 2, 3)] +
                              [(1, p, D(2024, 1, 5)) for p in range(30)],
                              "customer_id bigint, product_id bigint, date_viewed date")
    assert V.history_limit("abc") == 20 and V.history_limit(50) == 20 and V.history_limit(0) == 0
    assert V.recent_views(h, 0).count() == 0
    assert V.recent_views(h, 5).count() == 5
    assert V.recent_views(h, 50).count() == 20
    assert V.recent_views(h, "x").count() == 20
    seven = [r for r in V.recent_views(h, 50).collect() if r.product_id == 7]
    assert seven[0].date_viewed == D(2024, 1, 5)


def test_images_order_type_and_sort(spark):
    im = spark.createDataFrame([(1, 5, "a.png", None), (2, 5, "b.png", 3), (3, 5, "c.png", 1), (4, 6, "d.png", 0)],
                               "id bigint, product_id bigint, source string, sort_position bigint")
    t = _t(spark, product_images=im)
    assert [r.id for r in I.product_images_sorted(t, 5).collect()] == [3, 2, 1]
    rows = spark.createDataFrame([("x.PNG",), ("x.jpg",), ("noext",), ("a.b.jpeg",), (".png",)], "source string")
    got = {r.source: r.accepted for r in I.image_type_check(rows).collect()}
    assert got == {"x.PNG": False, "x.jpg": True, "noext": False, "a.b.jpeg": True, ".png": False}
    req = spark.createDataFrame([(1, 5, [3, 1, 3]), (2, 5, [1, 4])], "seq bigint, product_id bigint, image_ids array<bigint>")
    res = I.image_sort_order(t, req)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == {1: "OK", 2: "DOES_NOT_EXIST"}
    assert {r.id: r.sort_position for r in res.table.collect()} == {1: 1, 2: 3, 3: 2, 4: 0}


def test_email_check(spark):
    cases = {"a@b.co": True, "a..b@c.com": False, '"x y"@z.io': True, "a@[1.2.3.4]": True, "a@b": False,
             "a@b.c": False, "x@y.com\n": False}
    df = spark.createDataFrame([(i, e) for i, e in enumerate(cases)], "id bigint, email string")
    got = {r.email: r.valid_email for r in email_check(df).collect()}
    assert got == cases


def test_answer_scores(spark):
    answers = spark.createDataFrame([(1, 9, "a", 0), (2, 9, "b", 0), (3, 9, "c", 0)],
                                    "id bigint, question_id bigint, answer string, answered_by bigint")
    ratings = spark.createDataFrame([(1, 1, False), (1, 2, False), (2, 1, True)],
                                    "answer_id bigint, customer_id bigint, helpful boolean")
    t = _t(spark, product_question_answers=answers, product_question_answers_rating=ratings)
    got = [(r.id, r.overall_rating) for r in Q.answers_ranked_sorted(t).collect()]
    assert got == [(2, 1), (3, 0), (1, -2)]


def test_same_style_for_requests_and_last_purchase_for(spark):
    t = _shop(spark, [(1, 1, 1)], [(1, 1)])
    cat = C.product_catalog(t, D(2001, 1, 1))
    req = spark.createDataFrame([(1, 2), (2, 99)], "request_id bigint, product_id bigint")
    got = sorted((r.request_id, r.id) for r in C.products_same_style_for(cat, t.products, req).collect())
    assert got == [(1, 1), (1, 2), (1, 3)]
    lines = spark.createDataFrame([(100, 1, 2, 100)], "order_id bigint, product_id bigint, quantity bigint, price_cents bigint")
    t2 = t.with_tables(product_orders=lines)
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "customer_id bigint, product_id bigint")
    got = {r.product_id: r.last_purchased_on for r in O.last_purchase_for(t2, pairs).collect()}
    assert got == {1: dt.datetime(2000, 1, 1), 2: None}


def test_order_history_newest_first(spark):
    from marketlane.sources.tables import ShopTables as ST

    t = ST(spark, "/root/testdata/sf0.001")
    rows = O.order_history_sorted(t).select("placed_on", "id").collect()
    keys = [(r.placed_on, r.id) for r in rows]
    assert keys == sorted(keys, reverse=True) and len(keys) > 0


def test_batch_parse_equals_single_parse(spark):
    """The Spark-function query parser (C9) and the driver-side one (C8) agree
    on random query strings built from words, or, quotes and minus signs."""
    import random

    rnd = random.Random(11)
    atoms = ["red", "ring", "or", "OR", "-blue", '"hot gear"', '-"a b"', "x-y", "!!", "-", '"', "Gear", "-or"]
    queries = [(f"q{i}", " ".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 6)))) for i in range(200)]
    df = spark.createDataFrame(queries, "query_id string, query string")
    got = {}
    for r in S.parse_queries(df).collect():
        got.setdefault(r.query_id, {}).setdefault(r.branch, []).append((r.term, S.Term(r.negated, tuple(r.words))))
    for qid, text in queries:
        want = S.parse_query(text.strip())
        clauses = [[t for _, t in sorted(terms)] for _, terms in sorted(got.get(qid, {}).items())]
        assert clauses == want, (text, clauses, want)


def test_english_config(spark):
    from marketlane.functions.text import harman_s_stem, harman_s_stem_py

    words = ["ponies", "aies", "horses", "toes", "cats", "bus", "glass", "is", "s", "gear", "queries"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    spark_stems = [r.s for r in df.select(harman_s_stem(C.F.col("w")).alias("s")).collect()]
    assert spark_stems == [harman_s_stem_py(w) for w in words]
    assert harman_s_stem_py("ponies") == "pony" and harman_s_stem_py("horses") == "horse"
    assert harman_s_stem_py("cats") == "cat" and harman_s_stem_py("glass") == "glass"
    cat = spark.createDataFrame([(1, "The red rings"), (2, "a ring of gears"), (3, "blue pony")], "id bigint, name string")
    for c in ["available", "brand_name", "brand_id", "stock_count", "price", "description"]:
        cat = cat.withColumn(c, C.F.lit(None).cast("string"))
    assert sorted(r.id for r in S.product_search(cat, "ring", config="english").collect()) == [1, 2]
    assert sorted(r.id for r in S.product_search(cat, "ring", config="simple").collect()) == [2]
    assert sorted(r.id for r in S.product_search(cat, "the ponies", config="english").collect()) == [3]


def test_batch_search_english_agrees_with_single(spark):
    cat = spark.createDataFrame([(1, "The red rings"), (2, "a ring of gears"), (3, "blue pony"), (4, "red gear")],
                                "id bigint, name string")
    for c in ["available", "brand_name", "brand_id", "stock_count", "price", "description"]:
        cat = cat.withColumn(c, C.F.lit(None).cast("string"))
    qs = [("a", "rings"), ("b", "the gears or ponies"), ("c", "red -the -gear"), ("d", '"red ring"'), ("e", "the of")]
    res = S.product_search_batch(cat, spark.createDataFrame(qs, "query_id string, query string"), config="english")
    got = {}
    for r in res.matches.collect():
        got.setdefault(r.query_id, set()).add((r.id, r.rank))
    for qid, q in qs[:4]:
        assert got.get(qid, set()) == {(r.id, r.rank) for r in S.product_search(cat, q, config="english").collect()}, q
    assert [r.query_id for r in res.rejected.collect()] == ["e"]
