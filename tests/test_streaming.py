"""Stream = batch: S1 against V3, S2 against B2, with the events split into
several files read one file per micro-batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketlane.operators.basket import basket_fold
from marketlane.operators.history import record_views
from marketlane.sources.tables import DRIVER_SCHEMAS, ShopTables
from marketlane.streaming import basket_feed, view_history

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark):
    """The events table as 4 files in event order (increasing mtimes)."""
    d = tempfile.mkdtemp(prefix="ml-events-")
    ev = spark.read.parquet(os.path.join(SF, "events.parquet"))
    bounds = ev.select(F.min("event_id"), F.max("event_id")).first()
    lo, hi = bounds[0], bounds[1]
    step = (hi - lo) // 4 + 1
    for i in range(4):
        part = ev.where((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step))
        path = os.path.join(d, f"part-{i}")
        part.coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet"):
                os.rename(os.path.join(path, f), os.path.join(d, f"events-{i}.parquet"))
                os.utime(os.path.join(d, f"events-{i}.parquet"), (1_700_000_000 + i * 10,) * 2)
    return d


def _stream(spark, d):
    return spark.readStream.schema(DRIVER_SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(
        os.path.join(d, "*.parquet"))


def test_s1_equals_batch_v3(spark, split_events):
    t = ShopTables(spark, SF)
    out = view_history.stream_record_views(spark, SF, events=_stream(spark, split_events))
    got = {tuple(r) for r in view_history.read_history(spark, out).select(
        "customer_id", "product_id", "date_viewed").collect()}
    empty = spark.createDataFrame([], t.product_view_history.schema)
    batch = record_views(t.with_tables(product_view_history=empty),
                         t.view_events.withColumnRenamed("event_id", "seq")).table
    want = {tuple(r) for r in batch.select("customer_id", "product_id", "date_viewed").collect()}
    assert got == want and len(got) > 0


def test_s2_equals_batch_b2(spark, split_events):
    t = ShopTables(spark, SF)
    out = basket_feed.stream_basket_feed(spark, SF, events=_stream(spark, split_events))
    got = {tuple(r) for r in basket_feed.final_basket(spark, out).collect()}
    log = t.basket_events.select(F.col("event_id").alias("seq"), "customer_id", "product_id", "op", "quantity")
    want = {tuple(r) for r in basket_fold(t.products_in_basket, log, t.products, t.customer_accounts)
            .basket.select("customer_id", "product_id", "quantity").collect()}
    assert got == want
    batches = spark.read.parquet(os.path.join(out, "touched")).select("batch_id").distinct().count()
    assert batches == 4
    msgs = basket_feed.read_feed(spark, out).collect()
    assert msgs and all(m.message.startswith('{"type":"basketUpdate","basket":[') for m in msgs)


def test_feed_messages_are_paged_for_huge_baskets(spark):
    import json

    from marketlane.streaming.basket_feed import feed_messages

    basket = spark.createDataFrame([(1, p, 1) for p in range(25)] + [(2, 5, 3)],
                                   "customer_id bigint, product_id bigint, quantity bigint")
    touched = spark.createDataFrame([(1,), (2,), (3,)], "customer_id bigint")
    msgs = [(r.customer_id, json.loads(r.message)) for r in feed_messages(basket, touched, page_size=10).collect()]
    one = [m for c, m in msgs if c == 1]
    assert len(one) == 3 and {m["parts"] for m in one} == {3}
    assert sorted(i["productId"] for m in one for i in m["basket"]) == list(range(25))
    assert [m for c, m in msgs if c == 2] == [
        {"type": "basketUpdate", "basket": [{"productId": 5, "quantity": 3}], "part": 1, "parts": 1}]
    assert [m for c, m in msgs if c == 3] == [{"type": "basketUpdate", "basket": [], "part": 1, "parts": 1}]


def test_s2_resumes_from_a_stable_base(spark, split_events, tmp_path):
    """A second run on the same base finds no new input and keeps the state."""
    base = str(tmp_path / "s2")
    out = basket_feed.stream_basket_feed(spark, SF, events=_stream(spark, split_events), base=base)
    first = {tuple(r) for r in basket_feed.final_basket(spark, out).collect()}
    out2 = basket_feed.stream_basket_feed(spark, SF, events=_stream(spark, split_events), base=base)
    assert out2 == out
    assert {tuple(r) for r in basket_feed.final_basket(spark, out2).collect()} == first
    assert spark.read.parquet(os.path.join(out, "touched")).select("batch_id").distinct().count() == 4


def test_s2_compaction_keeps_state(spark, split_events, monkeypatch):
    monkeypatch.setattr(basket_feed, "COMPACT_EVERY", 2)
    t = ShopTables(spark, SF)
    out = basket_feed.stream_basket_feed(spark, SF, events=_stream(spark, split_events))
    snaps = spark.read.parquet(os.path.join(out, "snap")).select("batch_id").distinct().count()
    assert snaps == 2  # batch 0 and batch 2
    got = {tuple(r) for r in basket_feed.final_basket(spark, out).collect()}
    log = t.basket_events.select(F.col("event_id").alias("seq"), "customer_id", "product_id", "op", "quantity")
    want = {tuple(r) for r in basket_fold(t.products_in_basket, log, t.products, t.customer_accounts)
            .basket.select("customer_id", "product_id", "quantity").collect()}
    assert got == want


def test_view_batches_read_only_their_days(spark, tmp_path, monkeypatch):
    """20 batches of two days each: what a batch reads of the history does not grow with it."""
    import datetime as dt

    from marketlane.operators import history
    from marketlane.streaming import view_history

    source, base = str(tmp_path / "in"), str(tmp_path / "s1")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, props string"
    seen, judge = [], history.record_views

    def judged(tables, events):
        seen.append(tables.product_view_history.count())
        return judge(tables, events)

    monkeypatch.setattr(history, "record_views", judged)
    rows = []
    for n in range(20):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
        own = [(100 * n + i, day + dt.timedelta(days=i % 2), 1 + i % 30, "view", f"product {i % 9 + 1}") for i in range(40)]
        rows += own
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        view_history.stream_record_views(spark, "/root/testdata/sf0.001", events=events, base=base)
    assert len(seen) == 20 and max(seen[1:]) <= 2 * 40 and max(seen[10:]) <= max(seen[1:10])
    got = view_history.read_history(spark, f"{base}/history")
    want = {(u, int(p.split()[1]), ts.date()) for _, ts, u, _, p in rows}
    from marketlane.sources.tables import ShopTables

    known = {r.id for r in ShopTables(spark, "/root/testdata/sf0.001").customer_accounts.select("id").collect()}
    assert {tuple(r) for r in got.select("customer_id", "product_id", "date_viewed").collect()} == {w for w in want if w[0] in known}
    assert got.count() == got.distinct().count()
