"""Product images: reads and the sort-order change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_extension, has_image_extension


def product_images(tables, product_id: int | None = None) -> DataFrame:
    """Images of products (sorted by ``product_images_sorted``)."""
    im = tables.product_images
    if product_id is not None:
        im = im.where(F.col("product_id") == F.lit(product_id))
    return im.select("id", "product_id", F.col("source").alias("file_name"), "sort_position")


def product_images_sorted(tables, product_id: int | None = None) -> DataFrame:
    """I1 in the reference's order: by position, NULL last (PostgreSQL's
    ascending default), then id."""
    return product_images(tables, product_id).orderBy(
        "product_id", F.asc_nulls_last("sort_position"), "id")


def image_type_check(rows: DataFrame, source_col: str = "source") -> DataFrame:
    """Keep ``.png .jpeg .jpg`` (case-sensitive) and flag the rest."""
    return rows.withColumn("extension", file_extension(F.col(source_col))) \
               .withColumn("accepted", has_image_extension(F.col(source_col)))


# ---- changes (I2, I4) -----------------------------------------------------------

REJECTED_TYPE = "INVALID_FILE_TYPE"


def register_images(tables, batch: DataFrame):
    """I4 with I3: new image rows (unique source; FK product); a file with
    another extension is rejected before the insert. batch: seq, product_id, source."""
    from .changes import ChangeResult, insert_rows

    checked = batch.withColumn("_i_ok", has_image_extension(F.col("source")))
    rows = checked.where(F.col("_i_ok")).select("seq", "product_id", "source",
                                                F.lit(None).cast("bigint").alias("sort_position"))
    res = insert_rows(tables.product_images, rows, unique=["source"],
                      fks={"product_id": (tables.products, "id")}, id_col="id")
    out = (checked.join(res.outcomes.select("seq", "id", F.col("outcome").alias("_i_out")), "seq", "left")
           .select(*batch.columns, "id",
                   F.when(~F.col("_i_ok"), F.lit(REJECTED_TYPE)).otherwise(F.col("_i_out")).alias("outcome")))
    return ChangeResult(res.table, out)


def drop_images(tables, batch: DataFrame):
    """I4: delete image rows by id; also returns the deleted rows' source and
    product id (``DELETE .. RETURNING``) for file clean-up."""
    from .changes import delete_rows, deleted_rows

    b = batch.select("seq", "id")
    res = delete_rows(tables.product_images, b, key=["id"])
    returned = deleted_rows(tables.product_images, b, key=["id"]).select("id", "source", "product_id")
    return res, returned


def image_sort_order(tables, requests: DataFrame):
    """Per request (seq, product_id, image_ids ARRAY<BIGINT>), position =
    index of the id in the list, all or nothing: one id that is not an image
    of that product rejects the whole list (DOES_NOT_EXIST). A repeated id
    takes its last index. Accepted lists are applied in ``seq`` order (the
    last list touching an image wins)."""
    from ..functions.outcomes import DOES_NOT_EXIST, OK
    from .changes import ChangeResult

    im = tables.product_images
    items = requests.select("seq", "product_id", F.posexplode("image_ids").alias("pos", "id"))
    own = im.select("id", F.col("product_id").alias("_i_owner"))
    j = items.join(own, "id", "left")
    verdict = (j.groupBy("seq")
               .agg(F.bool_and(F.coalesce(F.col("_i_owner") == F.col("product_id"), F.lit(False))).alias("_i_ok")))
    out = (requests.join(verdict, "seq", "left")
           .select(*requests.columns,
                   F.when(F.coalesce("_i_ok", F.lit(True)), F.lit(OK)).otherwise(F.lit(DOES_NOT_EXIST))
                   .alias("outcome")))
    accepted = j.join(verdict.where("_i_ok"), "seq", "left_semi")
    newest = (accepted.groupBy("id")
              .agg(F.max_by(F.col("pos"), F.struct("seq", "pos")).cast("bigint").alias("_i_pos")))
    table = (im.join(newest, "id", "left")
             .select(*[F.coalesce("_i_pos", "sort_position").alias("sort_position") if c == "sort_position"
                       else F.col(c) for c in im.columns]))
    return ChangeResult(table, out)
