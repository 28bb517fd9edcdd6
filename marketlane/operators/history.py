"""View history and favourites (V1-V7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: most history rows returned per customer.
MAX_VIEW_HISTORY_LIMIT = 20


def history_limit(limit) -> int:
    """The route's rule: not a number -> 20; above 20 -> 20. PostgreSQL rounds a
    fractional LIMIT; a negative one is taken as 0 here."""
    if limit is None:
        return MAX_VIEW_HISTORY_LIMIT
    try:
        x = float(limit)
    except (TypeError, ValueError):
        return MAX_VIEW_HISTORY_LIMIT
    if math.isnan(x):
        return MAX_VIEW_HISTORY_LIMIT
    x = min(x, MAX_VIEW_HISTORY_LIMIT)
    return 0 if x < 0 else int(math.floor(x + 0.5))


def recent_views(history: DataFrame, limit=MAX_VIEW_HISTORY_LIMIT, customer_id: int | None = None) -> DataFrame:
    """V1: per customer, the latest view day of each product, newest first, top n.

    Latest-per-product is an aggregate (map-side combined), not a window, so a
    heavy viewer is never one window partition; the top-n is a row_number over
    the much smaller (customer, product) set, which Spark plans with a partial
    WindowGroupLimit before the exchange. Ties on the day go to the lower
    product id.
    """
    n = history_limit(limit)
    h = history
    if customer_id is not None:
        h = h.where(F.col("customer_id") == F.lit(customer_id))
    latest = h.groupBy("customer_id", "product_id").agg(F.max("date_viewed").alias("date_viewed"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("date_viewed"), F.asc("product_id"))
    return (latest.withColumn("position", F.row_number().over(w).cast("bigint"))
            .where(F.col("position") <= F.lit(n)))


def viewed_on_day(history: DataFrame, pairs: DataFrame, day) -> DataFrame:
    """V2: for each requested (customer_id, product_id), was it viewed on ``day``."""
    seen = (history.where(F.col("date_viewed") == F.lit(day).cast("date"))
            .select("customer_id", "product_id", F.lit(True).alias("_seen")).distinct())
    return (pairs.join(seen, ["customer_id", "product_id"], "left")
            .select(*pairs.columns, F.col("_seen").isNotNull().alias("viewed")))


def favourites(tables, customer_id: int | None = None) -> DataFrame:
    """V5: favourite product ids per customer."""
    f = tables.customer_favourite_products
    if customer_id is not None:
        f = f.where(F.col("customer_id") == F.lit(customer_id))
    return f.select("customer_id", "product_id")


def has_favourited(pairs: DataFrame, favs: DataFrame) -> DataFrame:
    """V6: boolean per requested (customer_id, product_id)."""
    mark = favs.select("customer_id", "product_id", F.lit(True).alias("_fav")).distinct()
    return (pairs.join(mark, ["customer_id", "product_id"], "left")
            .select(*pairs.columns, F.col("_fav").isNotNull().alias("favourited")))


# ---- changes (V3, V4, V7) -----------------------------------------------------

def record_views(tables, events: DataFrame):
    """V3: one history row per customer, product and day; a repeat on the same
    day is accepted silently (OK), an unknown product or customer is an FK
    violation. events: seq, customer_id, product_id, ts."""
    from ..functions.outcomes import CONFLICT, OK
    from .changes import ChangeResult, insert_rows

    batch = events.select("seq", "customer_id", "product_id", F.col("ts").cast("date").alias("date_viewed"))
    res = insert_rows(tables.product_view_history, batch, unique=["customer_id", "product_id", "date_viewed"],
                      fks={"product_id": (tables.products, "id"), "customer_id": (tables.customer_accounts, "id")})
    out = res.outcomes.withColumn("outcome", F.when(F.col("outcome") == CONFLICT, F.lit(OK))
                                  .otherwise(F.col("outcome")))
    return ChangeResult(res.table, out)


def remove_views(tables, batch: DataFrame):
    """V4: delete a product from a customer's history (every day of it)."""
    from .changes import delete_rows

    return delete_rows(tables.product_view_history, batch.select("seq", "customer_id", "product_id"),
                       key=["customer_id", "product_id"])


def set_favourites(tables, batch: DataFrame):
    """V7: mark favourites (unique pair; FK product and customer)."""
    from .changes import insert_rows

    return insert_rows(tables.customer_favourite_products, batch.select("seq", "customer_id", "product_id"),
                       unique=["customer_id", "product_id"],
                       fks={"product_id": (tables.products, "id"), "customer_id": (tables.customer_accounts, "id")})


def remove_favourites(tables, batch: DataFrame):
    """V7: unmark favourites."""
    from .changes import delete_rows

    return delete_rows(tables.customer_favourite_products, batch.select("seq", "customer_id", "product_id"),
                       key=["customer_id", "product_id"])
