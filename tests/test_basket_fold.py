"""B2 closed form against a one-change-at-a-time loop; scan helper checks."""

import random

import pytest
from pyspark.sql import functions as F

from marketlane.operators.basket import basket_fold
from marketlane.operators.scan import Running, running


def model_fold(opening, events, products, customers):
    basket = dict(opening)
    out = {}
    for seq, c, p, op, q in sorted(events):
        if op in ("add", "update") and (q is None or q <= 0):
            out[seq] = "REJECTED"
        elif op == "add":
            if (c, p) in basket:
                out[seq] = "CONFLICT"
            elif p not in products or c not in customers:
                out[seq] = "FOREIGN_KEY_VIOLATION"
            else:
                out[seq] = "OK"
                basket[(c, p)] = q
        elif op == "update":
            if (c, p) in basket:
                out[seq] = "OK"
                basket[(c, p)] = q
            else:
                out[seq] = "DOES_NOT_EXIST"
        elif op == "remove":
            if (c, p) in basket:
                out[seq] = "OK"
                del basket[(c, p)]
            else:
                out[seq] = "DOES_NOT_EXIST"
        else:
            mine = [k for k in basket if k[0] == c]
            out[seq] = "OK" if mine else "DOES_NOT_EXIST"
            for k in mine:
                del basket[k]
    return out, basket


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("ranges", [7, None])
def test_basket_fold_matches_loop(spark, seed, ranges):
    rnd = random.Random(seed)
    products = set(range(6))
    customers = {0, 1, 2}
    opening = {(c, p): rnd.randint(1, 5) for c in range(3) for p in range(7) if rnd.random() < 0.3 and p in products}
    ops = ["add"] * 4 + ["update"] * 2 + ["remove"] * 2 + ["clear"]
    seqs = rnd.sample(range(1, 200), 60)
    events = [(s, rnd.choice([0, 1, 2, 3]), rnd.randrange(7), rnd.choice(ops), rnd.choice([-1, 0, 1, 2, 3, None]))
              for s in seqs]
    b = spark.createDataFrame([(c, p, q) for (c, p), q in opening.items()],
                              "customer_id bigint, product_id bigint, quantity bigint")
    ev = spark.createDataFrame(events, "seq bigint, customer_id bigint, product_id bigint, op string, quantity bigint")
    prod = spark.createDataFrame([(p,) for p in products], "id bigint")
    cust = spark.createDataFrame([(c,) for c in customers], "id bigint")
    res = basket_fold(b, ev, prod, cust, ranges=ranges)
    want_out, want_basket = model_fold(opening, events, products, customers)
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    assert got == want_out
    assert {(r.customer_id, r.product_id): r.quantity for r in res.basket.collect()} == want_basket


def test_running_scan_crosses_buckets(spark):
    rows = [("a", i, i if i % 3 else None, 1) for i in range(1, 30)] + [("b", 5, 7, 2)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, x bigint")
    out = running(df, ["k"], "o", [Running("lv", "last", "v", True), Running("sx", "sum", "x", False)],
                  ranges=5)
    got = {(r.k, r.o): (r.lv, r.sx) for r in out.collect()}
    last = None
    for i in range(1, 30):
        assert got[("a", i)] == (last, i)
        if i % 3:
            last = i
    assert got[("b", 5)] == (None, 2)


def test_hot_key_with_sparse_order_is_spread(spark):
    """A third of the rows have one key, at orders far apart and in clusters: no range holds many more than its share."""
    from marketlane.operators.scan import ranged

    rows = [(0, i * 10**12 + (i % 3) * 10**5) for i in range(3_000)] + [(1 + i % 1_000, i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint").repartition(8)
    dealt = ranged(df, ["k"], "o", ranges=12)
    sizes = [r["count"] for r in dealt.groupBy("_s_range", "k").count().groupBy("_s_range").agg(F.max("count").alias("count")).collect()]
    assert max(sizes) <= 2 * len(rows) / 12
    out = running(df.withColumn("x", F.lit(1)), ["k"], "o", [Running("n", "sum", "x", False), Running("before", "last", "o")], ranges=12)
    hot = [(r.n, r.before) for r in out.where("k = 0").orderBy("o").collect()]
    orders = sorted(o for k, o in rows if k == 0)
    assert hot == [(i + 1, orders[i - 1] if i else None) for i in range(3_000)]
