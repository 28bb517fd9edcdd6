"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry runs an operator over the whole derived tables of one data folder.
Parameters fixed here (the pricing day, the search text ...) are arguments of
the operators, not filters that shrink the input.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import ShopTables

# Day the catalogue is priced on and "today" for changes that stamp a date.
AS_OF = dt.date(1999, 1, 1)
NOW = dt.datetime(1999, 1, 1, 12, 0, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[ShopTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ShopTables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing the modules fills QUERIES.
    from . import (catalog_queries, change_queries, checkout_queries, order_queries,  # noqa: F401
                   read_queries, search_queries, stream_queries)
    return dict(QUERIES)
