"""Lookup reads (T2-T4): small dimension tables and id lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lookup name -> (table, value column) for T2.
LOOKUPS = {
    "brands": ("brands", "name"),
    "product_types": ("product_types", "type"),
    "filter_categories": ("filter_categories", "name"),
    "order_statuses": ("order_statuses", "status"),
    "countries": ("shipping_countries", "name"),
}


def lookup(tables, name: str, id=None) -> DataFrame:
    """T2 (all rows) and T3 (one id; an empty result means NULL)."""
    table, value = LOOKUPS[name]
    df = tables[table].select("id", value)
    if id is not None:
        df = df.where(F.col("id") == F.lit(id))
    return df


def lookup_ids(tables, name: str, requests: DataFrame, id_col: str = "id") -> DataFrame:
    """T3 for a table of requested ids: every request row is kept, with the
    looked-up value or NULL when the id is absent (LEFT join)."""
    table, value = LOOKUPS[name]
    dim = tables[table].select(F.col("id").alias("_lookup_id"), F.col(value).alias(f"{value}"))
    return (requests.join(dim, requests[id_col] == dim._lookup_id, "left").drop("_lookup_id"))


def all_product_ids(tables) -> DataFrame:
    """T4: every product id."""
    return tables.products.select("id")
