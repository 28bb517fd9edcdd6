"""Basket reads and the basket change log.

``basket_fold`` applies an ordered log of add / update / remove / clear
changes to the stored basket in closed form, with the outcome each change gets
when run one at a time:

* add: CONFLICT when the product is already in the basket, else OK
  (FOREIGN_KEY_VIOLATION for an unknown product or customer);
* update, remove: OK when present, else DOES_NOT_EXIST;
* clear: OK when the basket holds at least one product, else DOES_NOT_EXIST;
* add / update with quantity <= 0 are REJECTED before reaching the table (B3).

After an add the product is present whatever the add's outcome, after a remove
absent, after a clear every product of the customer is absent. So presence
before a change is "the last add/remove of that pair is an add and comes after
the customer's last clear": two running ``last`` scans, no loop and no pairing
of clears with products. A clear finds a non-empty basket exactly when the
successful adds minus successful removes since the previous clear are > 0: one
aggregate per (customer, clear epoch).

A basket row whose product no change names needs no scan: it stays unless its customer
clears, and counts as one present row until the customer's first clear. These rows,
most of a large basket, are only split off, counted and cut by the clears.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import CONFLICT, DOES_NOT_EXIST, FOREIGN_KEY_VIOLATION, OK
from .. import session
from .joins import few_keys, many_keys
from .scan import Running, running

REJECTED = "REJECTED"
OPENING_SEQ = -(2 ** 63)

# The basket operations of the change log.
OPS = ("add", "update", "remove", "clear")


@dataclass
class BasketFold:
    outcomes: DataFrame
    basket: DataFrame


def basket_contents(tables, customer_id: int | None = None) -> DataFrame:
    """B1: product and quantity per customer."""
    b = tables.products_in_basket
    if customer_id is not None:
        b = b.where(F.col("customer_id") == F.lit(customer_id))
    return b.select("customer_id", "product_id", "quantity")


def basket_change_filter(changes: DataFrame) -> DataFrame:
    """Add and update need a quantity > 0 (the route's check)."""
    needs_qty = F.col("op").isin("add", "update")
    ok = ~needs_qty | (F.col("quantity").isNotNull() & (F.col("quantity") > 0))
    return changes.withColumn("_b_valid", ok)


def basket_fold(basket: DataFrame, changes: DataFrame, products: DataFrame | None = None,
                customers: DataFrame | None = None, ranges: int | None = None,
                materialize: bool = True) -> BasketFold:
    """B2: apply ``changes`` (seq, customer_id, product_id, op, quantity) to
    ``basket`` (customer_id, product_id, quantity).

    Returns the changes with ``outcome`` and the final basket. ``products`` and
    ``customers`` (``id`` columns) enable the FK check on add; they are first cut
    to the ids of the changes. With ``materialize`` the changes, the judged change
    rows, the last-clear scan and the marked basket, which several outputs read, are
    checkpointed once to the shared checkpoint folder. ``ranges``: see ``scan.running``.
    """
    if materialize:
        changes = session.materialize(changes)
    ev = basket_change_filter(changes)
    basket = _named(basket, changes)
    if materialize:
        basket = session.materialize(basket)
    rest = basket.where(~F.col("_b_named"))
    fk_ok = F.lit(True)
    parents = {c: t for c, t in (("product_id", products), ("customer_id", customers)) if t is not None}
    for column, asked in few_keys(ev, list(parents)).items():
        known = parents[column].select(F.col("id").alias(column)).join(asked, column, "left_semi").distinct()
        ev = ev.join(known.withColumn(f"_b_has_{column}", F.lit(True)), column, "left")
        fk_ok = fk_ok & F.col(f"_b_has_{column}").isNotNull()
    ev = ev.withColumn("_b_fk", fk_ok)
    op, valid = F.col("op"), F.col("_b_valid")

    # Presence flags: a valid add with its FKs sets present, a remove clears it.
    flag = (F.when((op == "add") & valid & F.col("_b_fk"), F.lit(True))
            .when(op == "remove", F.lit(False)))
    pair_events = (ev.where(op != "clear")
                   .select("seq", "customer_id", "product_id", "op", "quantity", "_b_valid", "_b_fk",
                           F.lit(False).alias("_b_open"),
                           F.when(flag.isNotNull(), F.struct(F.col("seq").alias("s"), flag.alias("f")))
                           .alias("_b_flag")))
    opening = basket.where("_b_named").select(
        F.lit(OPENING_SEQ).cast("bigint").alias("seq"), "customer_id", "product_id",
        F.lit("open").alias("op"), F.col("quantity").cast("bigint").alias("quantity"),
        F.lit(True).alias("_b_valid"), F.lit(True).alias("_b_fk"), F.lit(True).alias("_b_open"),
        F.struct(F.lit(OPENING_SEQ).cast("bigint").alias("s"), F.lit(True).alias("f")).alias("_b_flag"))
    pairs = running(pair_events.unionByName(opening), ["customer_id", "product_id"], "seq",
                    [Running("_b_last", "last", "_b_flag", exclusive=True)], ranges=ranges)

    # Last clear of the customer before each change.
    clears = ev.select("seq", "customer_id", F.when(op == "clear", F.col("seq")).alias("_b_clear_seq"),
                       F.col("op").alias("_b_op"))
    k = running(clears, ["customer_id"], "seq", [Running("_b_k", "last", "_b_clear_seq", exclusive=True)],
                ranges=ranges)
    k = k.select("seq", "customer_id", "_b_op", "_b_k")
    if materialize:
        k = session.materialize(k)

    p = pairs.join(k.drop("_b_op"), ["seq", "customer_id"], "left")
    last = F.col("_b_last")
    present = (last.isNotNull() & last["f"]
               & (F.col("_b_k").isNull() | (last["s"] > F.col("_b_k"))))
    pair_outcome = (F.when(~F.col("_b_valid"), F.lit(REJECTED))
                    .when(op == "add", F.when(present, F.lit(CONFLICT))
                          .when(~F.col("_b_fk"), F.lit(FOREIGN_KEY_VIOLATION)).otherwise(F.lit(OK)))
                    .when(present, F.lit(OK))
                    .otherwise(F.lit(DOES_NOT_EXIST)))
    judged_pairs = p.withColumn("outcome", F.when(F.col("_b_open"), F.lit(OK)).otherwise(pair_outcome))
    epoch = F.coalesce(F.col("_b_k"), F.lit(OPENING_SEQ))
    delta = (F.when(F.col("_b_open"), F.lit(1))
             .when((op == "add") & (F.col("outcome") == OK), F.lit(1))
             .when((op == "remove") & (F.col("outcome") == OK), F.lit(-1))
             .otherwise(F.lit(0)))
    judged_pairs = judged_pairs.withColumn("_b_epoch", epoch).withColumn("_b_delta", delta)
    if materialize:
        judged_pairs = session.materialize(judged_pairs)

    # A clear finds a non-empty basket when the net adds since the previous clear are > 0.
    unnamed = rest.select("customer_id", F.lit(OPENING_SEQ).cast("bigint").alias("_b_epoch"), F.lit(1).alias("_b_delta"))
    net = (judged_pairs.select("customer_id", "_b_epoch", "_b_delta").unionByName(unnamed)
           .groupBy("customer_id", "_b_epoch").agg(F.sum("_b_delta").alias("_b_net")))
    clear_rows = (k.where(F.col("_b_op") == "clear")
                  .withColumn("_b_epoch", F.coalesce(F.col("_b_k"), F.lit(OPENING_SEQ)))
                  .join(net, ["customer_id", "_b_epoch"], "left")
                  .select("seq", F.when(F.coalesce("_b_net", F.lit(0)) > 0, F.lit(OK))
                          .otherwise(F.lit(DOES_NOT_EXIST)).alias("_b_clear_outcome")))

    pair_out = judged_pairs.where(~F.col("_b_open")).select("seq", F.col("outcome").alias("_b_pair_outcome"))
    outcomes = (changes.join(pair_out, "seq", "left").join(clear_rows, "seq", "left")
                .select(*changes.columns,
                        F.coalesce("_b_pair_outcome", "_b_clear_outcome").alias("outcome")))

    # Final basket: pairs whose last flag is an add after the customer's last clear;
    # quantity from the last successful add or update (or the opening row).
    final_flag = (judged_pairs.where(F.col("_b_flag").isNotNull())
                  .groupBy("customer_id", "product_id")
                  .agg(F.max_by("_b_flag", "seq").alias("_b_fin")))
    qty_src = judged_pairs.where(F.col("_b_open") | (op.isin("add", "update") & (F.col("outcome") == OK)))
    final_qty = (qty_src.groupBy("customer_id", "product_id")
                 .agg(F.max_by("quantity", "seq").alias("quantity")))
    last_clear = (k.where(F.col("_b_op") == "clear").groupBy("customer_id").agg(F.max("seq").alias("_b_kfin")))
    final = (final_flag.join(last_clear, "customer_id", "left")
             .where(F.col("_b_fin")["f"] & (F.col("_b_kfin").isNull() | (F.col("_b_fin")["s"] > F.col("_b_kfin"))))
             .join(final_qty, ["customer_id", "product_id"], "left")
             .select("customer_id", "product_id", F.col("quantity").cast("bigint").alias("quantity")))
    kept = (rest.join(_marked(changes.where(op == "clear"), ["customer_id"]), "customer_id", "left_anti")
            .groupBy("customer_id", "product_id").agg(F.max("quantity").cast("bigint").alias("quantity")))
    return BasketFold(outcomes, final.unionByName(kept))


def _marked(changes: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys of ``changes``, for a broadcast where they are few, else a sort-merge join."""
    keys = changes.select(*key).dropna().distinct()
    return keys.hint("merge") if many_keys(changes, key) else F.broadcast(keys)


def _named(basket: DataFrame, changes: DataFrame) -> DataFrame:
    """``basket`` with ``_b_named``: whether a change names the row's customer and product,
    or one of the two is not known."""
    key = ["customer_id", "product_id"]
    named = _marked(changes.where(F.col("op") != "clear"), key).withColumn("_b_hit", F.lit(True))
    some = F.col("_b_hit").isNotNull() | F.col("customer_id").isNull() | F.col("product_id").isNull()
    return basket.join(named, key, "left").select(*key, "quantity", some.alias("_b_named"))
