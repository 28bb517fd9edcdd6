"""T5: versions, touched buckets, and what a small batch writes and reads."""

from pathlib import Path

import pytest

from marketlane.operators import changes as W
from marketlane.sources import sinks


def _table(spark, rows):
    return spark.range(1, rows + 1).selectExpr("id", "concat('name ', id) AS name")


def _batch(spark, ids, columns="seq bigint, id bigint, name string"):
    return spark.createDataFrame([(i + 1, k, f"new {k}") for i, k in enumerate(ids)], columns)


def _bytes(root, part, version):
    return sum(f.stat().st_size for f in Path(root, part, f"v={version}").rglob("*.parquet"))


def _rows(df):
    return {r.id: r.name for r in df.collect()}


def _store(spark, tmp_path, rows, monkeypatch, name="t"):
    monkeypatch.setattr(sinks, "ROWS_PER_BUCKET", 100)
    root = str(tmp_path / f"{name}{rows}")
    table = _table(spark, rows)
    sinks.write_parts(root, 0, keyed={"table": sinks.Keyed(table, ["id"], table.select("id"))})
    return root


def test_small_batch_writes_no_more_into_a_larger_table(spark, tmp_path, monkeypatch):
    written = {}
    for rows in (2_000, 20_000):
        root = _store(spark, tmp_path, rows, monkeypatch)
        batch = _batch(spark, range(1, 11))
        target = sinks.read_table(spark, root, keys=batch)
        assert target.count() <= 10 * 200                   # the buckets of ten keys
        sinks.write_changes(W.update_rows(target, batch, ["id"], ["name"]), root, 1, ["id"])
        written[rows] = _bytes(root, "table", 1)
        want = _rows(_table(spark, rows)) | {k: f"new {k}" for k in range(1, 11)}
        assert _rows(sinks.read_table(spark, root)) == want
    assert written[20_000] < 1.5 * written[2_000] and _bytes(root, "table", 0) > 10 * written[20_000]


def test_all_change_kinds_through_the_store(spark, tmp_path, monkeypatch):
    root = _store(spark, tmp_path, 1_000, monkeypatch)
    want = _rows(_table(spark, 1_000))
    steps = [
        (lambda t, b: W.insert_rows(t, b, unique=["id"]), [5, 2001, 2002], lambda k: {**want, **{i: f"new {i}" for i in k if i > 2000}}),
        (lambda t, b: W.update_rows(t, b, ["id"], ["name"]), [7, 2001, 9999], lambda k: {**want, 7: "new 7", 2001: "new 2001"}),
        (lambda t, b: W.delete_rows(t, b, ["id"]), [8, 2002, 9999], lambda k: {i: n for i, n in want.items() if i not in (8, 2002)}),
        (lambda t, b: W.upsert_rows(t, b, ["id"]), [9, 3000], lambda k: {**want, 9: "new 9", 3000: "new 3000"}),
    ]
    for version, (change, ids, expect) in enumerate(steps, 1):
        batch = _batch(spark, ids)
        before = version - 1
        result = change(sinks.read_table(spark, root, keys=batch), batch)
        sinks.write_changes(result, root, version, ["id"])
        want = expect(ids)
        assert sinks.latest_version(spark, root) == version == before + 1
        assert _rows(sinks.read_table(spark, root)) == want
        assert sinks.read_table(spark, root, "outcomes").count() == len(ids)
    # By a join instead of named folders; and without the folders of overwritten buckets.
    monkeypatch.setattr(sinks, "NAMED_FOLDERS", 1)
    assert _rows(sinks.read_table(spark, root)) == want
    assert sinks.retire(spark, root, "table") > 0 and sinks.retire(spark, root, "table") == 0
    assert _rows(sinks.read_table(spark, root)) == want


def test_uncommitted_versions_and_emptied_buckets(spark, tmp_path, monkeypatch):
    root = _store(spark, tmp_path, 300, monkeypatch)
    # A job that died before its commit.
    _table(spark, 5).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{root}/table/v=1")
    assert sinks.latest_version(spark, root) == 0 and sinks.read_table(spark, root).count() == 300
    every = _batch(spark, range(1, 301))
    sinks.write_changes(W.delete_rows(sinks.read_table(spark, root, keys=every), every, ["id"]), root, 1, ["id"])
    empty = sinks.read_table(spark, root)
    assert empty.count() == 0 and empty.columns == ["id", "name"]
    again = _batch(spark, [4])
    sinks.write_changes(W.upsert_rows(empty, again, ["id"]), root, 2, ["id"])
    sinks.write_changes(W.upsert_rows(empty, again, ["id"]), root, 2, ["id"])      # a retry
    assert _rows(sinks.read_table(spark, root)) == {4: "new 4"}
    assert sinks.read_table(spark, root, "nothing") is None and sinks.read_table(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        sinks.write_parts(root, 3, keyed={"table": sinks.Keyed(empty, ["name"], empty)})


def test_second_checkout_writes_touched_buckets(spark, tmp_path, monkeypatch):
    from marketlane.plans.checkout import bulk_checkout, checkout_requests_with_codes, write_checkout
    from marketlane.plans.registry import AS_OF, NOW
    from marketlane.sources.tables import ShopTables

    monkeypatch.setattr(sinks, "ROWS_PER_BUCKET", 20)
    t, root = ShopTables(spark, "/root/testdata/sf0.001"), str(tmp_path / "shop")
    none = checkout_requests_with_codes(t).limit(0)
    write_checkout(bulk_checkout(t, none, AS_OF, NOW), root, 0)
    for name in ("stock", "discount_codes", "basket"):
        assert sinks.read_table(spark, root, name).count() > 0
    res = bulk_checkout(t, checkout_requests_with_codes(t).orderBy("request_id").limit(1), AS_OF, NOW)
    write_checkout(res, root, 1)
    for name in ("stock", "basket"):
        got, want = sinks.read_table(spark, root, name), getattr(res, name)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert _bytes(root, "stock", 1) < _bytes(root, "stock", 0) / 2
