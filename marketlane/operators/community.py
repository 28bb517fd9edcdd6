"""Reviews, questions, answers and answer ratings: the read half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import cut_if_few, cut_to_keys, few_keys


def product_reviews(reviews: DataFrame, product_id: int | None = None) -> DataFrame:
    """Reviews of products with created / updated dates."""
    r = reviews if product_id is None else reviews.where(F.col("product_id") == F.lit(product_id))
    return r.select("id", "customer_id", "product_id", "rating", "text", "created_on", "updated_on")


def product_questions(tables, product_id: int | None = None) -> DataFrame:
    """Q1: questions of products."""
    q = tables.product_questions
    if product_id is not None:
        q = q.where(F.col("product_id") == F.lit(product_id))
    return q.select("id", "product_id", "asked_by", "question")


def helpful_counts(ratings: DataFrame) -> DataFrame:
    """Q4: number of votes per (answer, helpful)."""
    return ratings.groupBy("answer_id", "helpful").agg(F.count(F.lit(1)).alias("count"))


def answer_scores(ratings: DataFrame) -> DataFrame:
    """helpful - unhelpful votes per rated answer (NULL votes count for neither)."""
    vote = F.when(F.col("helpful"), F.lit(1)).when(~F.col("helpful"), F.lit(-1)).otherwise(F.lit(0))
    return ratings.groupBy("answer_id").agg(F.sum(vote).cast("bigint").alias("overall_rating"))


def answers_ranked(tables, question_id: int | None = None) -> DataFrame:
    """Q2: answers of questions with their overall rating (0 when unrated).

    One aggregate over the ratings joined to the answers replaces the
    reference's query per answer; for one question the ratings are first cut to its
    answers. Sort with ``answers_ranked_sorted``.
    """
    a, ratings = tables.product_question_answers, tables.product_question_answers_rating
    if question_id is not None:
        a = a.where(F.col("question_id") == F.lit(question_id))
        ratings = cut_to_keys(ratings, a.select(F.col("id").alias("answer_id")), ["answer_id"])
    scores = answer_scores(ratings)
    return (a.join(scores, a.id == scores.answer_id, "left")
            .select("id", "question_id", "answer", "answered_by",
                    F.coalesce("overall_rating", F.lit(0)).cast("bigint").alias("overall_rating")))


def answers_ranked_sorted(tables, question_id: int | None = None) -> DataFrame:
    return answers_ranked(tables, question_id).orderBy(F.desc("overall_rating"), "id")


def answer_rating(tables, requests: DataFrame) -> DataFrame:
    """Q3: for requested (answer_id, customer_id), the answer's rating and the
    customer's own vote (NULL when they did not vote). Ratings are first cut to the
    requested answers."""
    ratings = cut_to_keys(tables.product_question_answers_rating, requests, ["answer_id"])
    scores = answer_scores(ratings)
    own = ratings.select("answer_id", "customer_id", F.col("helpful").alias("user_found_helpful"))
    return (requests.join(scores, "answer_id", "left")
            .join(own, ["answer_id", "customer_id"], "left")
            .select("answer_id", "customer_id",
                    F.coalesce("overall_rating", F.lit(0)).cast("bigint").alias("rating"),
                    "user_found_helpful"))


# ---- changes (R2-R4, Q5, Q6) --------------------------------------------------

REJECTED = "REJECTED"
NOT_PURCHASED = "NOT_PURCHASED"

REVIEW_SCHEMA = ("id bigint, customer_id bigint, product_id bigint, rating bigint, text string, "
                 "created_on date, updated_on date")


def empty_reviews(spark) -> DataFrame:
    return spark.createDataFrame([], REVIEW_SCHEMA)


def _rating_ok(col):
    return col.isNotNull() & (col >= 0) & (col <= 10)


def review_intake(tables, reviews: DataFrame, submissions: DataFrame, materialize: bool = True):
    """R2: new reviews. A rating outside 0..10 is REJECTED; a customer who never
    bought the product gets NOT_PURCHASED; the stored rating is ``floor``; one
    review per customer and product (later ones CONFLICT).

    submissions: seq, customer_id, product_id, rating, review, created_on.
    With ``materialize`` the batch and its gated rows are checkpointed once (each is
    read three times).
    """
    from ..session import materialize as _materialize
    from .changes import ChangeResult, insert_rows

    if materialize:
        # The batch is read by the gate, the insert and the outcome merge.
        submissions = _materialize(submissions)
    # Purchase gate: orders are cut to the batch's customers and lines to its products
    # before they meet, so the order history is neither exchanged nor deduplicated; with
    # more of them than one broadcast holds, the exchange to cut them is left out.
    asked = few_keys(submissions, ["customer_id", "product_id"])
    orders = cut_if_few(tables.shop_orders.select("id", "customer_id"), asked["customer_id"], "customer_id")
    lines = cut_if_few(tables.product_orders.select(F.col("order_id").alias("id"), "product_id"), asked["product_id"], "product_id")
    wanted = submissions.select("customer_id", "product_id").distinct()
    bought = (lines.join(orders, "id").join(wanted, ["customer_id", "product_id"], "left_semi")
              .select("customer_id", "product_id").distinct().withColumn("_r_bought", F.lit(True)))
    s = submissions.join(bought, ["customer_id", "product_id"], "left")
    valid = _rating_ok(F.col("rating"))
    gate = s.withColumn("_r_gate", F.when(~valid, F.lit(REJECTED))
                        .when(F.col("_r_bought").isNull(), F.lit(NOT_PURCHASED)))
    if materialize:
        gate = _materialize(gate)
    batch = gate.where(F.col("_r_gate").isNull()).select(
        "seq", "customer_id", "product_id", F.floor("rating").cast("bigint").alias("rating"),
        F.col("review").alias("text"), "created_on", F.lit(None).cast("date").alias("updated_on"))
    res = insert_rows(reviews, batch, unique=["customer_id", "product_id"],
                      fks={"product_id": (tables.products, "id"), "customer_id": (tables.customer_accounts, "id")},
                      id_col="id")
    judged = res.outcomes.select("seq", "id", F.col("outcome").alias("_r_out"))
    out = (gate.join(judged, "seq", "left")
           .select(*submissions.columns, "id", F.coalesce("_r_gate", "_r_out").alias("outcome")))
    return ChangeResult(res.table, out)


def review_updates(reviews: DataFrame, batch: DataFrame, day):
    """Change rating and text of one's own review (key id + customer);
    same range check and floor, no purchase gate; ``updated_on`` = day.
    batch: seq, id, customer_id, rating, review."""
    from .changes import ChangeResult, update_rows

    valid = _rating_ok(F.col("rating"))
    ok_rows = batch.where(valid).select(
        "seq", "id", "customer_id", F.floor("rating").cast("bigint").alias("rating"),
        F.col("review").alias("text"), F.lit(day).cast("date").alias("updated_on"))
    res = update_rows(reviews, ok_rows, key=["id", "customer_id"], set_cols=["rating", "text", "updated_on"])
    out = (batch.join(res.outcomes.select("seq", F.col("outcome").alias("_r_out")), "seq", "left")
           .select(*batch.columns, F.coalesce("_r_out", F.lit(REJECTED)).alias("outcome")))
    return ChangeResult(res.table, out)


def review_deletes(reviews: DataFrame, batch: DataFrame):
    """Delete one's own review (key id + customer)."""
    from .changes import delete_rows

    return delete_rows(reviews, batch.select("seq", "id", "customer_id"), key=["id", "customer_id"])


def rate_answers(tables, batch: DataFrame):
    """Q5: vote on an answer (one vote per customer and answer)."""
    from .changes import insert_rows

    return insert_rows(tables.product_question_answers_rating, batch.select("seq", "answer_id", "customer_id", "helpful"),
                       unique=["answer_id", "customer_id"],
                       fks={"answer_id": (tables.product_question_answers, "id"),
                            "customer_id": (tables.customer_accounts, "id")})


def change_answer_ratings(tables, batch: DataFrame):
    """Q5: change one's vote (key answer + customer)."""
    from .changes import update_rows

    return update_rows(tables.product_question_answers_rating, batch.select("seq", "answer_id", "customer_id", "helpful"),
                       key=["answer_id", "customer_id"], set_cols=["helpful"])


def withdraw_answer_ratings(tables, batch: DataFrame):
    """Q5: withdraw one's vote."""
    from .changes import delete_rows

    return delete_rows(tables.product_question_answers_rating, batch.select("seq", "answer_id", "customer_id"),
                       key=["answer_id", "customer_id"])


def ask_questions(tables, batch: DataFrame):
    """Q6: new questions (FK product and customer; new id = max + seq)."""
    from .changes import insert_rows

    return insert_rows(tables.product_questions, batch.select("seq", "product_id", "asked_by", "question"),
                       fks={"product_id": (tables.products, "id"), "asked_by": (tables.customer_accounts, "id")},
                       id_col="id")


def edit_questions(tables, batch: DataFrame):
    """Q6: new text of a question by id (the documented meaning)."""
    from .changes import update_rows

    return update_rows(tables.product_questions, batch.select("seq", "id", "question"), key=["id"],
                       set_cols=["question"])


def delete_questions(tables, batch: DataFrame):
    from .changes import delete_rows

    return delete_rows(tables.product_questions, batch.select("seq", "id"), key=["id"])


def answer_questions(tables, batch: DataFrame):
    """Q6: new answers (FK question and answering account)."""
    from .changes import insert_rows

    return insert_rows(tables.product_question_answers, batch.select("seq", "question_id", "answered_by", "answer"),
                       fks={"question_id": (tables.product_questions, "id"),
                            "answered_by": (tables.accounts, "id")},
                       id_col="id")
