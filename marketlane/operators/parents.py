"""W3 with a look at the children: deletes of rows that others refer to.

A foreign key says what a parent's deletion does to the rows that refer to it:
``restrict`` refuses it, ``cascade`` deletes them as well (and looks at their own
children), ``set_null`` empties their reference. The keys are walked from the deleted
table downwards, each table once, with every doomed row's key beside the statement's
key that dooms it. One refusing row anywhere below refuses the whole statement, as one
statement is all or nothing. A table is cut to the rows that refer to doomed keys before
anything else is done with it, so a small batch exchanges none of its other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import DOES_NOT_EXIST, FOREIGN_KEY_VIOLATION, OK
from ..session import materialize
from .joins import cut_to_keys


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str = "id"
    on_delete: str = "restrict"     # or "cascade", "set_null"


@dataclass
class Deletion:
    tables: dict[str, DataFrame]    # the tables that may have changed
    outcomes: DataFrame


def walk_order(root: str, keys: list[ForeignKey]) -> list[ForeignKey]:
    """The keys below ``root``, every parent's incoming cascades before its own keys."""
    for k in keys:
        if k.on_delete not in ("restrict", "cascade", "set_null"):
            raise ValueError(f"{k.child}.{k.column}: unknown rule {k.on_delete!r}")
    reached, grown = {root}, True
    while grown:
        grown = False
        for k in keys:
            if k.parent in reached and k.on_delete == "cascade" and k.child not in reached:
                reached.add(k.child)
                grown = True
    below = [k for k in keys if k.parent in reached]
    out = []
    while len(out) < len(below):
        waiting = {k.child for k in below if k not in out and k.on_delete == "cascade"}
        ready = [k for k in below if k not in out and k.parent not in waiting]
        if not ready:
            raise ValueError(f"cascades below {root} form a circle")
        out += ready
    return out


def delete_parents(tables: dict[str, DataFrame], root: str, batch: DataFrame, keys: list[ForeignKey], column: str = "id") -> Deletion:
    """Delete the rows of ``root`` whose ``column`` is in ``batch`` (seq, ``column``).

    Outcomes in ``seq`` order: DOES_NOT_EXIST where no row has the key (or an earlier
    statement has deleted it), FOREIGN_KEY_VIOLATION where a ``restrict`` key refuses,
    else OK. A refusing row counts as the tables stand before the batch. ``tables`` has
    the root and all children of ``keys``."""
    asked = batch.where(F.col(column).isNotNull())
    present = cut_to_keys(tables[root].select(column), asked, [column]).distinct().select(F.col(column).alias("root_key"))
    # By table and referenced column: the doomed keys, each with the statement's key.
    order = walk_order(root, keys)
    doomed = {(root, column): materialize(present.select("root_key", F.col("root_key").alias("key")))}
    blocked = None
    for k in order:
        above = doomed.get((k.parent, k.parent_column))
        if above is None:
            continue
        wanted = sorted({x.parent_column for x in order if x.parent == k.child}) if k.on_delete == "cascade" else []
        if k.on_delete == "restrict" or wanted:
            rows = cut_to_keys(tables[k.child].select(F.col(k.column).alias("key"), *[F.col(c).alias(f"of_{c}") for c in wanted]), above, ["key"])
            hit = rows.join(above, "key")
            if k.on_delete == "restrict":
                found = hit.select("root_key").distinct()
                blocked = found if blocked is None else blocked.unionByName(found)
            for c in wanted:
                more = hit.select("root_key", F.col(f"of_{c}").alias("key")).where("key is not null").distinct()
                held = doomed.get((k.child, c))
                doomed[k.child, c] = materialize(more if held is None else held.unionByName(more).distinct())
    blocked = (present.limit(0) if blocked is None else blocked).distinct().withColumn("refused", F.lit(True))
    verdict = materialize(present.join(blocked, "root_key", "left"))

    first = asked.groupBy(column).agg(F.min("seq").alias("first_seq"))
    judged = (batch.join(verdict.withColumnRenamed("root_key", column).withColumn("found", F.lit(True)), column, "left").join(first, column, "left"))
    outcome = (F.when(F.col("found").isNull(), F.lit(DOES_NOT_EXIST)).when(F.col("refused"), F.lit(FOREIGN_KEY_VIOLATION))
               .when(F.col("seq") == F.col("first_seq"), F.lit(OK)).otherwise(F.lit(DOES_NOT_EXIST)))
    outcomes = judged.withColumn("outcome", outcome).select(*batch.columns, "outcome")

    allowed = verdict.where("refused is null").select("root_key")
    gone = {at: keys_of.join(allowed, "root_key", "left_semi").select("key").distinct() for at, keys_of in doomed.items()}
    changed = {root: tables[root].join(gone[root, column].withColumnRenamed("key", column), column, "left_anti").select(*tables[root].columns)}
    for k in order:
        above = gone.get((k.parent, k.parent_column))
        if above is None or k.on_delete == "restrict":
            continue
        table = changed.get(k.child, tables[k.child])
        above = above.withColumnRenamed("key", k.column)
        if k.on_delete == "cascade":
            changed[k.child] = table.join(above, k.column, "left_anti").select(*table.columns)
        else:
            marked = table.join(above.withColumn("_gone", F.lit(True)), k.column, "left")
            changed[k.child] = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == k.column else F.col(c) for c in table.columns])
    return Deletion(changed, outcomes)


# The catalogue's keys, as its statements need them: a brand's products go with it unless
# they were ordered or lie in a basket.
CATALOGUE_KEYS = [
    ForeignKey("base_products", "brand_id", "brands", on_delete="cascade"),
    ForeignKey("products", "base_product_id", "base_products", on_delete="cascade"),
    ForeignKey("assigned_product_type", "product_id", "base_products", on_delete="cascade"),
    ForeignKey("product_stock_levels", "product_id", "products", on_delete="cascade"),
    ForeignKey("product_prices", "product_id", "products", on_delete="cascade"),
    ForeignKey("product_images", "product_id", "products", on_delete="set_null"),
    ForeignKey("product_orders", "product_id", "products", on_delete="restrict"),
    ForeignKey("products_in_basket", "product_id", "products", on_delete="restrict"),
]


def with_rule(keys: list[ForeignKey], on_delete: str) -> list[ForeignKey]:
    """All of ``keys`` under one rule."""
    return [ForeignKey(k.child, k.column, k.parent, k.parent_column, on_delete) for k in keys]
