"""Addresses and accounts: the read half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_valid_email
from ..session import materialize

ADDRESS_COLUMNS = ["id", "customer_id", "area_code", "first_address_line", "second_address_line",
                   "state", "country_id"]

# The five role tables an account can belong to.
ROLE_TABLES = ("customer_accounts", "admin_accounts", "sale_accounts", "support_accounts", "warehouse_accounts")


def customer_addresses(tables, customer_id: int | None = None) -> DataFrame:
    """A1: addresses with their country name (LEFT: unsupported country -> NULL)."""
    a = tables.shipping_addresses
    if customer_id is not None:
        a = a.where(F.col("customer_id") == F.lit(customer_id))
    c = tables.shipping_countries.select(F.col("id").alias("_cid"), F.col("name").alias("country_name"))
    return (a.join(c, a.country_id == c._cid, "left")
            .select(*ADDRESS_COLUMNS, "country_name"))


def default_addresses(tables, customer_id: int | None = None) -> DataFrame:
    """A2: each customer's default address, LEFT joined from the default table."""
    d = tables.default_shipping_address
    if customer_id is not None:
        d = d.where(F.col("customer_id") == F.lit(customer_id))
    a = tables.shipping_addresses.select(
        F.col("id").alias("_aid"), "area_code", "first_address_line", "second_address_line", "state", "country_id")
    c = tables.shipping_countries.select(F.col("id").alias("_cid"), F.col("name").alias("country_name"))
    return (d.join(a, d.shipping_address_id == a._aid, "left")
            .join(c, F.col("country_id") == c._cid, "left")
            .select("customer_id", F.col("_aid").alias("id"), "area_code", "first_address_line",
                    "second_address_line", "state", "country_id", "country_name"))


def role_rows(tables) -> DataFrame:
    """The five role tables as one (account_table, role_id, account_id) frame."""
    cust = tables.customer_accounts.select(F.lit("customer_accounts").alias("account_table"),
                                           F.col("id").alias("role_id"), "account_id")
    staff = tables.staff_accounts.select("account_table", F.col("id").alias("role_id"), "account_id")
    return cust.unionByName(staff)


def account_types(tables) -> DataFrame:
    """A5: per account and role table, the role id (NULL when not in that table).

    The role tables are read as one union; accounts are expanded to the five
    table names with an ``explode`` of a literal array (no join needed), then
    the role rows are LEFT joined on (account, table).
    """
    acc = tables.accounts.select(F.col("id").alias("account_id"),
                                 F.explode(F.array(*[F.lit(t) for t in ROLE_TABLES])).alias("account_table"))
    roles = role_rows(tables)
    return (acc.join(roles, ["account_id", "account_table"], "left")
            .select("account_id", "account_table", "role_id",
                    F.col("role_id").isNotNull().alias("is_account_type")))


def account_lookup(tables, emails: DataFrame) -> DataFrame:
    """Account by exact e-mail (case-sensitive, not trimmed); the password
    column is never read."""
    acc = tables.accounts.select(F.col("email").alias("_email"), F.col("id").alias("account_id"))
    return (emails.join(acc, emails.email == acc._email, "left").drop("_email"))


def account_email(tables, ids: DataFrame) -> DataFrame:
    """E-mail of each requested account id (NULL when absent)."""
    acc = tables.accounts.select(F.col("id").alias("account_id"), "email")
    return ids.join(acc, "account_id", "left")


def email_check(accounts: DataFrame) -> DataFrame:
    """Flag each row's e-mail against the reference's pattern."""
    return accounts.select("id", "email", is_valid_email(F.col("email")).alias("valid_email"))


# ---- changes (A3, A4, A8) -----------------------------------------------------

def create_addresses(tables, batch: DataFrame):
    """A3: new addresses (FK country and customer; new id = max + seq)."""
    from .changes import insert_rows

    cols = ["seq", "customer_id", "area_code", "first_address_line", "second_address_line", "state", "country_id"]
    return insert_rows(tables.shipping_addresses, batch.select(*cols),
                       fks={"country_id": (tables.shipping_countries, "id"),
                            "customer_id": (tables.customer_accounts, "id")},
                       id_col="id")


def delete_addresses(tables, batch: DataFrame):
    """A3: delete one's own address (key id + customer)."""
    from .changes import delete_rows

    return delete_rows(tables.shipping_addresses, batch.select("seq", "id", "customer_id"),
                       key=["id", "customer_id"])


def set_default_addresses(tables, batch: DataFrame):
    """A4: set a default (one per customer; FK address; the address's owner is
    not checked, as in the reference)."""
    from .changes import insert_rows

    return insert_rows(tables.default_shipping_address, batch.select("seq", "customer_id", "shipping_address_id"),
                       unique=["customer_id"],
                       fks={"shipping_address_id": (tables.shipping_addresses, "id"),
                            "customer_id": (tables.customer_accounts, "id")})


def change_default_addresses(tables, batch: DataFrame):
    """A4: change the default (key customer; FK address)."""
    from .changes import update_rows

    return update_rows(tables.default_shipping_address, batch.select("seq", "customer_id", "shipping_address_id"),
                       key=["customer_id"], set_cols=["shipping_address_id"],
                       fks={"shipping_address_id": (tables.shipping_addresses, "id")})


def delete_default_addresses(tables, batch: DataFrame):
    from .changes import delete_rows

    return delete_rows(tables.default_shipping_address, batch.select("seq", "customer_id"), key=["customer_id"])


INVALID_EMAIL = "INVALID_EMAIL"


def account_intake(tables, batch: DataFrame):
    """New accounts with their role row, all or nothing per request.

    batch: seq, email, account_table (one of the five role tables). The e-mail
    is trimmed and checked (INVALID_EMAIL); a used e-mail is CONFLICT. The new
    account id is ``max(id) + seq`` and the role row's id ``max(role id) + seq``.
    Returns (tables, outcomes per request).
    """
    from pyspark.sql import functions as F

    from .admin import GROUP_STRIDE
    from .changes import GroupPart, insert_groups, trim_columns

    # Every step below reads the checked batch: the pattern is tried once a request, by all tasks.
    b = trim_columns(batch.select("seq", "email", "account_table").repartition("seq"), ["email"])
    b = materialize(b.withColumn("_a_ok", is_valid_email(F.col("email"))))
    good = b.where(F.col("_a_ok"))
    acc = tables.accounts
    acc_max = acc.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    roles = role_rows(tables)
    role_max = roles.select(F.coalesce(F.max("role_id"), F.lit(0))).scalar()
    acc_rows = good.select(F.col("seq").alias("group_id"), (F.col("seq") * GROUP_STRIDE).alias("seq"),
                           (acc_max + F.col("seq")).alias("id"), "email")
    role_new = good.select(F.col("seq").alias("group_id"), (F.col("seq") * GROUP_STRIDE + 1).alias("seq"),
                           "account_table", (role_max + F.col("seq")).alias("role_id"),
                           (acc_max + F.col("seq")).alias("account_id"))
    parents = acc.select("id").unionByName(acc_rows.select("id"))
    parts = [
        GroupPart("accounts", acc, acc_rows, unique=["email"]),
        GroupPart("roles", roles, role_new, unique=["account_table", "account_id"],
                  fks={"account_id": (parents, "id")}),
    ]
    new_tables, verdicts = insert_groups(parts)
    out = (b.join(verdicts.withColumnRenamed("group_id", "seq"), "seq", "left")
           .select("seq", "email", "account_table",
                   F.when(~F.col("_a_ok"), F.lit(INVALID_EMAIL)).otherwise(F.col("outcome")).alias("outcome")))
    return new_tables, out
