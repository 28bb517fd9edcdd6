"""Competition for stock against a plain loop, in one block and in many."""

import random

import pytest

from marketlane.operators import allocation


@pytest.mark.parametrize("seed,size", [(1, 50_000), (2, 25), (3, 10)])
def test_serial_allocation_matches_loop(spark, monkeypatch, seed, size):
    monkeypatch.setattr(allocation, "BLOCK_LINES", size)
    rounds, replay = [], allocation._replay
    monkeypatch.setattr(allocation, "_replay", lambda *a: rounds.append(1) or replay(*a))
    rnd = random.Random(seed)
    stock = {p: rnd.choice([0, 3, 30, 200, None]) for p in range(8)}
    lines = [(r, 0 if rnd.random() < 0.3 else rnd.choice([*range(10), None]), rnd.choice([1, 2, 5, 9, None]), rnd.choice([True] * 12 + [False, None]))
             for r in rnd.sample(range(1000), 150) for _ in range(rnd.randint(1, 3))]
    left, want, by_request = {p: n for p, n in stock.items() if n is not None}, {}, {}
    for r, p, q, flag in lines:
        total, flags = by_request.setdefault(r, {}).get(p, (None, []))
        by_request[r][p] = (q if total is None else total + (q or 0), [*flags, flag])
    for r in sorted(by_request):
        own = by_request[r]
        want[r] = all(False not in flags and (q is None or p not in left or q <= left[p]) for p, (q, flags) in own.items())
        for p, (q, _) in own.items() if want[r] else ():
            if p in left and q is not None:
                left[p] -= q
    got = allocation.serial_allocation(spark.createDataFrame(lines, "request_id bigint, product_id bigint, quantity int, available boolean").repartition(4),
                                       spark.createDataFrame(list(stock.items()), "product_id bigint, amount int"))
    assert {r.request_id: r.allocated for r in got.collect()} == want
    assert 0 < sum(want.values()) < len(want) and (size > 1000) == (len(rounds) == 1)


def test_only_lines_that_order_decides_are_replayed(spark, monkeypatch):
    seen = []

    def in_blocks(rows, order, size, real=allocation.in_blocks):
        seen.extend((r.request_id, r.product_id) for r in rows.collect())
        return real(rows, order, size)

    monkeypatch.setattr(allocation, "in_blocks", in_blocks)
    lines = [(1, 1, 3, True), (2, 1, 3, True), (2, 2, 9, True), (3, 1, 3, True), (4, 1, 4, False), (5, 3, 2, True), (6, 3, 2, None), (6, 4, 1, True), (7, 3, 1, True), (8, 5, 2, True)]
    stock = [(1, 6), (2, 8), (3, 3), (5, None)]
    got = allocation.serial_allocation(spark.createDataFrame(lines, "request_id bigint, product_id bigint, quantity bigint, available boolean"),
                                       spark.createDataFrame(stock, "product_id bigint, amount bigint"))
    assert {r.request_id: r.allocated for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}
    assert sorted(seen) == [(5, 3), (6, 3), (7, 3)]


def test_stock_that_a_negative_quantity_gives_back_is_counted(spark):
    lines = [(1, 1, -4, True), (2, 1, 7, True), (3, 1, 5, True)]
    got = allocation.serial_allocation(spark.createDataFrame(lines, "request_id bigint, product_id bigint, quantity bigint, available boolean"),
                                       spark.createDataFrame([(1, 4)], "product_id bigint, amount bigint"))
    assert {r.request_id: r.allocated for r in got.collect()} == {1: True, 2: True, 3: False}


def test_a_request_without_an_id_is_refused_as_others_are(spark):
    lines = [(None, 1, 9, True), (2, 1, 3, True)]
    got = allocation.serial_allocation(spark.createDataFrame(lines, "request_id bigint, product_id bigint, quantity bigint, available boolean"),
                                       spark.createDataFrame([(1, 4)], "product_id bigint, amount bigint"))
    assert {r.request_id: r.allocated for r in got.collect()} == {None: False, 2: True}
