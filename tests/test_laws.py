
import datetime as dt

from pyspark.sql import functions as F

from marketlane.functions.validation import is_array_of_numbers, is_array_of_strings
from marketlane.operators import history as V
from marketlane.plans.checkout import bulk_checkout, checkout_requests_with_codes
from marketlane.plans.registry import AS_OF, NOW
from marketlane.sources.tables import ShopTables

SF = "/root/testdata/sf0.001"


def test_w1_one_outcome_per_batch_row(spark):
    t = ShopTables(spark, SF)
    batch = t.view_events.select(F.col("event_id").alias("seq"), "customer_id", "product_id")
    res = V.set_favourites(t, batch)
    assert res.outcomes.count() == batch.count()
    ok = res.outcomes.where("outcome = 'OK'").count()
    assert res.table.count() == t.customer_favourite_products.count() + ok


def test_checkout_conserves_stock_and_rejections_change_only_purges(spark):
    t = ShopTables(spark, SF)
    req = checkout_requests_with_codes(t)
    res = bulk_checkout(t, req, AS_OF, NOW)
    before = t.product_stock_levels.select(F.sum("amount")).first()[0]
    after = res.stock.select(F.sum("amount")).first()[0]
    stocked = t.product_stock_levels.select("product_id")
    ordered = (res.order_lines.join(stocked, "product_id", "left_semi").select(F.sum("quantity")).first()[0] or 0)
    assert before - after == ordered
    # Orders are written exactly for OK requests, with one line per basket line seen.
    ok = res.statuses.where("status = 'OK'")
    assert res.orders.count() == ok.count()
    # Baskets of customers whose request was not OK lose only purged products.
    not_ok = res.statuses.where("status <> 'OK'").select("customer_id")
    kept = t.products_in_basket.join(not_ok, "customer_id", "left_semi")
    after_b = res.basket.join(not_ok, "customer_id", "left_semi")
    lost = kept.join(after_b, ["customer_id", "product_id"], "left_anti")
    assert lost.join(res.basket.select("product_id").distinct(), "product_id", "left_semi").count() == 0
    assert res.basket.columns == t.products_in_basket.columns
    # Nothing changes when every request is rejected before the basket step.
    bad = req.withColumn("shipping_address_id", F.lit(-1))
    res2 = bulk_checkout(t, bad, AS_OF, NOW)
    assert res2.orders.count() == 0
    assert res2.basket.exceptAll(t.products_in_basket).count() == 0
    assert t.products_in_basket.exceptAll(res2.basket).count() == 0
    assert res2.stock.exceptAll(t.product_stock_levels).count() == 0


def test_request_array_checks(spark):
    df = spark.createDataFrame([(["1", "2.5"],), (["1", "x"],), ([],), (None,), (["a", None],)], "a array<string>")
    got = [(r.n, r.s) for r in df.select(is_array_of_numbers(F.col("a")).alias("n"),
                                         is_array_of_strings(F.col("a")).alias("s")).collect()]
    assert got == [(True, True), (False, True), (True, True), (False, False), (False, False)]
    assert dt.date(1999, 1, 1) == AS_OF


def test_write_checkout_version(spark, tmp_path):
    from marketlane.plans.checkout import CHECKOUT_OUTPUTS, write_checkout
    from marketlane.sources.sinks import latest_version, read_table

    t = ShopTables(spark, SF)
    res = bulk_checkout(t, checkout_requests_with_codes(t), AS_OF, NOW)
    root = str(tmp_path / "checkout")
    write_checkout(res, root, 7)
    assert latest_version(spark, root) == 7
    for name in CHECKOUT_OUTPUTS:
        assert read_table(spark, root, name).count() == getattr(res, name).count()
