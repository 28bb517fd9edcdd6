"""Batches beyond one broadcast: what the plans hold and how often the batch is worked out."""

import pytest

from marketlane.operators import accounts, basket, changes, joins


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_insert_rows_sorts_a_large_batch_once(spark, no_broadcast):
    """A task of the last step holds the batch and the facts of its keys, nothing else."""
    target = spark.createDataFrame([(1, 10)], "k bigint, fk bigint")
    rows = [(1, 1, 10), (2, 2, 99), (3, 2, 10), (4, 2, 10), (5, 2, 99), (6, None, 10), (7, None, 99), (8, 3, None), (9, 1, 99)]
    batch = spark.createDataFrame(rows, "seq bigint, k bigint, fk bigint")
    parent = spark.createDataFrame([(10,)], "id bigint")
    out = changes.insert_rows(target, batch, unique=["k"], fks={"fk": (parent, "id")}).outcomes
    assert plan(out).count("Sort [") <= 2
    assert {r.seq: r.outcome for r in out.collect()} == {
        1: "CONFLICT", 2: "FOREIGN_KEY_VIOLATION", 3: "OK", 4: "CONFLICT", 5: "CONFLICT", 6: "OK", 7: "FOREIGN_KEY_VIOLATION", 8: "OK", 9: "CONFLICT"}


class Accounts:
    def __init__(self, spark):
        self.accounts = spark.createDataFrame([(1, "a@x.org")], "id bigint, email string")
        self.customer_accounts = spark.createDataFrame([(1, 1)], "id bigint, account_id bigint")
        self.staff_accounts = spark.createDataFrame([], "id bigint, account_id bigint, account_table string")


@pytest.mark.parametrize("rows", [0, 500_000])
def test_account_intake_checks_each_request_once(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    emails = ["a@x.org", " b@x.org", "nobody", "b@x.org ", "c@x.org", "b@x.org", None]
    batch = spark.createDataFrame([(i, e, "customer_accounts") for i, e in enumerate(emails, 1)], "seq bigint, email string, account_table string")
    tables, out = accounts.account_intake(Accounts(spark), batch)
    assert "rlike" not in plan(out).lower()      # the pattern is not tried again for each step that reads the batch
    assert {r.seq: r.outcome for r in out.collect() if r.seq < 7} == {
        1: "CONFLICT", 2: "OK", 3: "INVALID_EMAIL", 4: "CONFLICT", 5: "OK", 6: "CONFLICT"}
    assert sorted(r.email for r in tables["accounts"].collect()) == ["a@x.org", "b@x.org", "c@x.org"]


@pytest.mark.parametrize("rows", [0, 500_000])
def test_basket_rows_that_no_change_names_are_not_scanned(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    scanned, running = [], basket.running
    monkeypatch.setattr(basket, "running", lambda df, keys, *a, **b: scanned.append((len(keys), df.count())) or running(df, keys, *a, **b))
    held = spark.createDataFrame([(c, p, c + p) for c in range(4) for p in range(50)], "customer_id bigint, product_id bigint, quantity bigint")
    log = spark.createDataFrame([(1, 0, 3, "update", 9), (2, 1, None, "clear", 1), (3, 1, None, "clear", 1), (4, 1, 7, "add", 2), (5, 2, 60, "add", 1), (6, 3, 4, "remove", 1), (7, 5, 4, "clear", 1)],
                                "seq bigint, customer_id bigint, product_id bigint, op string, quantity bigint")
    res = basket.basket_fold(held, log)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == {1: "OK", 2: "OK", 3: "DOES_NOT_EXIST", 4: "OK", 5: "OK", 6: "OK", 7: "DOES_NOT_EXIST"}
    want = {(c, p): c + p for c in (0, 2, 3) for p in range(50)} | {(0, 3): 9, (1, 7): 2, (2, 60): 1}
    del want[3, 4]
    got = res.basket.collect()
    assert {(r.customer_id, r.product_id): r.quantity for r in got} == want and len(got) == len(want)
    assert [n for keys, n in scanned if keys == 2] == [4 + 3]      # four changes of products, and the rows (0, 3), (1, 7), (3, 4)
