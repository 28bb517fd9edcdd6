"""As-of prices, requested styles, drawn products, list checks and ranked batches against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlane.functions.validation import is_array_of_numbers, is_array_of_strings
from marketlane.operators import catalog as C
from marketlane.operators import search as S


def test_price_on_days(spark):
    rnd = random.Random(4)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    prices = {(p, n): rnd.randrange(1000) for p in range(6) for n in rnd.sample(range(50), 8)}
    asked = [(i, 0 if i % 3 == 0 else rnd.choice([1, 2, 3, 99, None]), None if i % 40 == 7 else day(rnd.randrange(-5, 60))) for i in range(300)]
    got = C.price_on_days(spark.createDataFrame([(p, day(n), c) for (p, n), c in prices.items()], "product_id bigint, date_active_from date, price_cents bigint"),
                          spark.createDataFrame(asked, "request_id bigint, product_id bigint, day date").repartition(5))
    want = {}
    for i, p, d in asked:
        held = [(day(n), c) for (q, n), c in prices.items() if q == p and d is not None and day(n) <= d]
        want[i] = (max(held)[1], max(held)[0]) if held else (None, None)
    assert {r.request_id: (r.price_cents, r.price_date) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [100_000, 7])
def test_same_style_of_a_hot_style(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "HOT_STYLE", limit)
    base = {i: (1 if i % 3 == 0 else i % 20 if i % 7 else None) for i in range(1, 121)}
    products = spark.createDataFrame(list(base.items()), "id bigint, base_product_id bigint")
    catalog = products.select("*", F.lit("n").alias("name"), F.lit(True).alias("available"), F.lit(1).alias("stock_count"), F.lit(1.0).alias("price"))
    asked = [(n, p) for n, p in enumerate([3, 3, 5, 7, 500, 120])]
    got = C.products_same_style_for(catalog, products, spark.createDataFrame(asked, "request_id bigint, product_id bigint"))
    want = sorted((n, p, i) for n, p in asked for i, b in base.items() if base.get(p) is not None and b == base[p])
    assert sorted((r.request_id, r.requested_id, r.id) for r in got.collect()) == want


def test_random_products_are_drawn_by_seed(spark):
    catalog = spark.range(200).select("id", F.lit("n").alias("name"), F.lit(True).alias("available"), F.lit(1).alias("stock_count"), F.lit(1.0).alias("price"))
    draw = lambda df, n, seed: [r.id for r in C.random_products(df, n, seed).collect()]
    whole = draw(catalog, 10, 1)
    assert len(set(whole)) == 10 and whole == draw(catalog.repartition(7), 10, 1) != draw(catalog, 10, 2)
    parts = catalog.where("id < 100"), catalog.where("id >= 100")
    merged = parts[0].where(F.col("id").isin(draw(parts[0], 10, 1))).unionByName(parts[1].where(F.col("id").isin(draw(parts[1], 10, 1))))
    assert draw(merged, 10, 1) == whole
    assert len(draw(catalog, "no number", 3)) == 1 and draw(catalog, -4, 3) == []


def test_list_checks(spark):
    cases = {"1": True, "-1.5e3": True, ".5": True, "5.": True, ".": False, "": True, " \t\n": True, "0x1F": True, "0xG": False, "0o17": True, "0b101": True, "0b12": False,
             "Infinity": True, "+Infinity": True, "inf": False, "NaN": False, "1d": False, "1f": False, "1 2": False, "1_0": False, None: True, "- 1": False, "-0x1": False, "1e": False}
    rows = [([x],) for x in cases] + [([],), (None,), (["1", "x"],)]
    df = spark.createDataFrame(rows, "a array<string>")
    got = [(r.n, r.s) for r in df.select(is_array_of_numbers(F.col("a")).alias("n"), is_array_of_strings(F.col("a")).alias("s")).collect()]
    assert got == [(fine, x is not None) for x, fine in cases.items()] + [(True, True), (False, False), (False, True)]


def test_batch_positions_and_top(spark):
    names = ["red hat", "red red", "hat", "red", "blue hat red", "नमस्ते red", "नमस"]
    catalog = spark.createDataFrame([(i, n, True, "b", 1, 1, 1.0, "d") for i, n in enumerate(names)],
                                    "id bigint, name string, available boolean, brand_name string, brand_id bigint, stock_count bigint, price double, description string")
    queries = spark.createDataFrame([("r", "red"), ("h", "hat or blue"), ("m", "नमस्ते"), ("x", "-red")], "query_id string, query string")
    every = S.product_search_batch(catalog, queries).matches.collect()
    for query, text in (("r", "red"), ("h", "hat or blue"), ("m", "नमस्ते")):
        alone = [r.id for r in S.product_search_sorted(catalog, text).collect()]
        assert [r.id for r in sorted((r for r in every if r.query_id == query), key=lambda r: r.position)] == alone
        assert [r.position for r in sorted((r for r in every if r.query_id == query), key=lambda r: r.position)] == list(range(1, len(alone) + 1))
    assert [r.id for r in every if r.query_id == "m"] == [5]
    top = S.product_search_batch(catalog, queries, top=2).matches
    assert {(r.query_id, r.position, r.id) for r in top.collect()} == {(r.query_id, r.position, r.id) for r in every if r.position <= 2}
    assert "WindowGroupLimit" in top._jdf.queryExecution().explainString(top._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
