import __spark_entry__ as entry


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "customer_id", "status", "shipping_address_id", "product_count", "total",
                          "price_paid", "placed_on"]
    assert df.count() > 0


def test_registry_and_oracle_keys(spark):
    q = entry.queries()
    sql = entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 90
