"""Catalogue upkeep as keyed bulk changes (instances of W1-W6).

Brands, product types, base products with their types, products with their
stock row and first price, names, descriptions and dated prices. Every batch
carries ``seq``; every function returns a ``ChangeResult`` (or, for the
all-or-nothing creations, the new tables and one outcome per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_cents
from .changes import (ChangeResult, GroupPart, delete_rows, insert_groups, insert_rows, trim_columns,
                      update_rows, upsert_rows)
from .parents import CATALOGUE_KEYS, Deletion, delete_parents, with_rule

# Rows of one group get seq = group seq * GROUP_STRIDE + position (parent first).
GROUP_STRIDE = 1000


def _max_id(df: DataFrame, col: str = "id"):
    return df.select(F.coalesce(F.max(col), F.lit(0)).alias("_m")).scalar()


# ---- brands and product types (W1 unique name / W2 / W3) --------------------

def create_brands(tables, batch: DataFrame) -> ChangeResult:
    """batch: seq, name. Names are trimmed; a taken name is CONFLICT."""
    return insert_rows(tables.brands, trim_columns(batch.select("seq", "name"), ["name"]),
                       unique=["name"], id_col="id")


def rename_brands(tables, batch: DataFrame) -> ChangeResult:
    """batch: seq, id, name."""
    return update_rows(tables.brands, trim_columns(batch.select("seq", "id", "name"), ["name"]),
                       key=["id"], set_cols=["name"], unique=["name"])


def delete_brands(tables, batch: DataFrame) -> ChangeResult:
    return delete_rows(tables.brands, batch.select("seq", "id"), key=["id"])


def delete_catalogue_rows(tables, root: str, batch: DataFrame, on_delete: str | None = None) -> Deletion:
    """W3 on ``brands`` or ``base_products`` (seq, id) with the parent side: the rows
    that refer to a deleted one go, empty their reference, or refuse the deletion
    (``parents.CATALOGUE_KEYS``). ``on_delete`` puts all keys under one rule."""
    keys = CATALOGUE_KEYS if on_delete is None else with_rule(CATALOGUE_KEYS, on_delete)
    names = {root} | {k.child for k in keys}
    return delete_parents({n: getattr(tables, n) for n in names}, root, batch.select("seq", "id"), keys)


def create_product_types(tables, batch: DataFrame) -> ChangeResult:
    """batch: seq, type."""
    return insert_rows(tables.product_types, trim_columns(batch.select("seq", "type"), ["type"]),
                       unique=["type"], id_col="id")


def rename_product_types(tables, batch: DataFrame) -> ChangeResult:
    return update_rows(tables.product_types, trim_columns(batch.select("seq", "id", "type"), ["type"]),
                       key=["id"], set_cols=["type"], unique=["type"])


def delete_product_types(tables, batch: DataFrame) -> ChangeResult:
    return delete_rows(tables.product_types, batch.select("seq", "id"), key=["id"])


# ---- base products ----------------------------------------------------------

def create_base_products(tables, batch: DataFrame):
    """A base product and its type assignments, all or nothing.

    batch: seq, description, brand_id, type_ids ARRAY<BIGINT>. The new id is
    ``max(id) + seq``; the group is ``seq``. Returns (tables, outcomes).
    """
    bp = tables.base_products
    new_id = (_max_id(bp) + F.col("seq")).cast("bigint")
    base_rows = batch.select(
        F.col("seq").alias("group_id"), (F.col("seq") * GROUP_STRIDE).alias("seq"),
        new_id.alias("id"), F.col("description"), F.col("brand_id").cast("bigint").alias("brand_id"),
        F.lit(None).cast("string").alias("p_brand"), F.lit(None).cast("string").alias("p_type"))
    type_rows = batch.select(F.col("seq").alias("group_id"), new_id.alias("product_id"),
                             F.posexplode("type_ids").alias("pos", "type_id")).select(
        "group_id", (F.col("group_id") * GROUP_STRIDE + F.col("pos") + 1).alias("seq"),
        "product_id", F.col("type_id").cast("bigint").alias("type_id"))
    parents = bp.select("id").unionByName(base_rows.select("id"))
    parts = [
        GroupPart("base_products", bp, base_rows, fks={"brand_id": (tables.brands, "id")}),
        GroupPart("assigned_product_type", tables.assigned_product_type, type_rows,
                  unique=["product_id", "type_id"],
                  fks={"product_id": (parents, "id"), "type_id": (tables.product_types, "id")}),
    ]
    return insert_groups(parts)


def delete_base_products(tables, batch: DataFrame) -> ChangeResult:
    return delete_rows(tables.base_products, batch.select("seq", "id"), key=["id"])


def set_base_product_brands(tables, batch: DataFrame) -> ChangeResult:
    """batch: seq, id, brand_id (NULL clears the brand)."""
    return update_rows(tables.base_products, batch.select("seq", "id", "brand_id"), key=["id"],
                       set_cols=["brand_id"], fks={"brand_id": (tables.brands, "id")})


def set_base_product_descriptions(tables, batch: DataFrame) -> ChangeResult:
    return update_rows(tables.base_products, trim_columns(batch.select("seq", "id", "description"), ["description"]),
                       key=["id"], set_cols=["description"])


def assign_types(tables, requests: DataFrame):
    """W5 per request: all (base product, type) pairs or none; a pair already
    assigned is CONFLICT. requests: seq, product_id, type_ids ARRAY<BIGINT>."""
    rows = requests.select(F.col("seq").alias("group_id"), "product_id",
                           F.posexplode("type_ids").alias("pos", "type_id")).select(
        "group_id", (F.col("group_id") * GROUP_STRIDE + F.col("pos")).alias("seq"),
        F.col("product_id").cast("bigint").alias("product_id"), F.col("type_id").cast("bigint").alias("type_id"))
    part = GroupPart("assigned_product_type", tables.assigned_product_type, rows,
                     unique=["product_id", "type_id"],
                     fks={"product_id": (tables.base_products, "id"), "type_id": (tables.product_types, "id")})
    return insert_groups([part])


def unassign_types(tables, batch: DataFrame) -> ChangeResult:
    """W3 on (product_id, type_id); absent pairs are still OK."""
    return delete_rows(tables.assigned_product_type, batch.select("seq", "product_id", "type_id"),
                       key=["product_id", "type_id"], missing_ok=True)


# ---- products and prices ----------------------------------------------------

def create_products(tables, batch: DataFrame, day):
    """Product + stock row + first price (dated ``day``), all or nothing.

    batch: seq, name, description, base_product_id, amount, price (two
    decimals, stored as cents). New id = ``max(id) + seq``.
    """
    p = tables.products
    new_id = (_max_id(p) + F.col("seq")).cast("bigint")
    trimmed = trim_columns(batch, ["name", "description"])
    g = F.col("seq").alias("group_id")
    prod = trimmed.select(g, (F.col("seq") * GROUP_STRIDE).alias("seq"), new_id.alias("id"), "name",
                          "description", F.col("base_product_id").cast("bigint").alias("base_product_id"),
                          F.lit(True).alias("available"))
    stock = trimmed.select(g, (F.col("seq") * GROUP_STRIDE + 1).alias("seq"), new_id.alias("product_id"),
                           F.col("amount").cast("bigint").alias("amount"))
    price = trimmed.select(g, (F.col("seq") * GROUP_STRIDE + 2).alias("seq"), new_id.alias("product_id"),
                           F.lit(day).cast("date").alias("date_active_from"),
                           to_cents(F.col("price")).alias("price_cents"))
    parents = p.select("id").unionByName(prod.select("id"))
    parts = [
        GroupPart("products", p, prod, fks={"base_product_id": (tables.base_products, "id")}),
        GroupPart("product_stock_levels", tables.product_stock_levels, stock, unique=["product_id"],
                  fks={"product_id": (parents, "id")}),
        GroupPart("product_prices", tables.product_prices, price, unique=["product_id", "date_active_from"],
                  fks={"product_id": (parents, "id")}),
    ]
    return insert_groups(parts)


def rename_products(tables, batch: DataFrame) -> ChangeResult:
    return update_rows(tables.products, trim_columns(batch.select("seq", "id", "name"), ["name"]),
                       key=["id"], set_cols=["name"])


def set_product_descriptions(tables, batch: DataFrame) -> ChangeResult:
    """batch: seq, id, description (NULL clears)."""
    return update_rows(tables.products, trim_columns(batch.select("seq", "id", "description"), ["description"]),
                       key=["id"], set_cols=["description"])


def set_prices(tables, batch: DataFrame, order_cols: list[str] | None = None) -> ChangeResult:
    """W4 keyed (product_id, date_active_from): a second price on the same day
    replaces the first. batch: seq, product_id, date_active_from, price_cents."""
    return upsert_rows(tables.product_prices, batch, key=["product_id", "date_active_from"],
                       fks={"product_id": (tables.products, "id")}, order_cols=order_cols)


def set_order_statuses(tables, batch: DataFrame) -> ChangeResult:
    """Set the status of orders (W2, FK to the status table)."""
    return update_rows(tables.shop_orders, batch.select("seq", "id", "status_id"), key=["id"],
                       set_cols=["status_id"], fks={"status_id": (tables.order_statuses, "id")})
