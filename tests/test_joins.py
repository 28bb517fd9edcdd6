"""Small sides are broadcast by their measured size; the large side stays in place."""

from pyspark.sql import functions as F

from marketlane.operators import changes as W
from marketlane.operators import joins
from marketlane.session import materialize


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_leave_the_large_table_in_place(spark):
    big = spark.range(10_000).select("id", (F.col("id") % 7).alias("v"))
    keys = spark.createDataFrame([(3,), (3,), (5,), (None,), (20_000,)], "id bigint")
    cut = joins.cut_to_keys(big, keys, ["id"])
    assert "BroadcastHashJoin" in _plan(cut) and "Exchange hashpartitioning" not in _plan(cut)
    assert sorted(r.id for r in cut.collect()) == [3, 5]


def test_keys_beyond_the_limit_give_the_same_rows(spark, monkeypatch):
    big = spark.range(1_000).select("id")
    keys = spark.range(0, 1_000, 3).select("id")
    small = {r.id for r in joins.cut_to_keys(big, keys, ["id"]).collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    cut = joins.cut_to_keys(big, keys, ["id"])
    assert "SortMergeJoin" in _plan(cut)
    assert {r.id for r in cut.collect()} == small == set(range(0, 1_000, 3))


def test_empty_keys(spark):
    keys = spark.createDataFrame([], "id bigint")
    assert joins.cut_to_keys(spark.range(10).select("id"), keys, ["id"]).count() == 0


def test_fk_check_of_a_small_batch_does_not_shuffle_the_parent(spark):
    parent = spark.range(10_000).select("id")
    batch = spark.createDataFrame([(1, 5), (2, None), (3, 20_000)], "seq bigint, ref bigint")
    checked = W._with_fk_checks(batch, {"ref": (parent, "id")})
    scan = _plan(checked).split("Range (0, 10000")[0].splitlines()
    assert not any("hashpartitioning(id" in line for line in scan)
    assert {r.seq: r._w_fk_ok for r in checked.collect()} == {1: True, 2: True, 3: False}


def test_one_basket_exchanges_no_large_table(spark):
    """For one customer's basket the price log, stock and products meet the basket's ids
    by broadcast: nothing is exchanged before that, and no plan aggregates the whole log."""
    from marketlane.operators import community, orders
    from marketlane.plans.registry import AS_OF
    from marketlane.sources.tables import ShopTables

    t = ShopTables(spark, "/root/testdata/sf0.001")
    t = t.with_tables(product_prices=t.product_prices.checkpoint(), product_stock_levels=t.product_stock_levels.checkpoint(),
                      products=t.products.checkpoint(), products_in_basket=t.products_in_basket.checkpoint())
    customer = t.products_in_basket.first().customer_id
    checked = orders.basket_check(t, AS_OF, customer)
    optimized = checked._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("LeftSemi") == 3
    every = {tuple(r) for r in orders.basket_check(t, AS_OF).where(F.col("customer_id") == customer).collect()}
    assert {tuple(r) for r in checked.collect()} == every and every
    question = t.product_question_answers.first().question_id
    ranked = community.answers_ranked(t, question)
    assert "LeftSemi" in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in ranked.collect()} == {tuple(r) for r in community.answers_ranked(t).where(F.col("question_id") == question).collect()}


def test_many_keys_leave_the_large_side_whole(spark, monkeypatch):
    big, batch = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).withColumnRenamed("id", "k")
    few = joins.few_keys(batch, ["k"])["k"]
    assert joins.cut_if_few(big, few, "k").count() == 20 and not joins.many_keys(batch, ["k"])
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    many = joins.few_keys(batch, ["k"])["k"]
    assert joins.cut_if_few(big, many, "k") is big and joins.many_keys(batch, ["k"])


def test_an_intermediate_is_written_once(spark):
    held = materialize(spark.range(3))
    assert materialize(held) is held
