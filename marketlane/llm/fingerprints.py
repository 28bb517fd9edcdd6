"""Threshold-scaled document sketches.

A document's sketch keeps every 5-word shingle hash below a fixed fraction of
the hash range. Sketches of the same fraction merge by union, and the share of
one sketch found in another estimates containment, also between documents of
very different length. All in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import partitions_for, pick

WIDTH = 5
SCALE = 8          # one shingle hash in SCALE is kept
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all ``width``-word shingles; fewer words, but not none, are one shingle."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0))

    def of(h: Column) -> Column:
        return (F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
                .when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
                .otherwise(F.array().cast("array<bigint>")))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 1/``scale`` of the range. A text whose
    hashes all lie above keeps its smallest one, so only a text without words has an
    empty sketch. A null text is empty."""
    return _bind(shingles(F.coalesce(text, F.lit("")), width), lambda h: _kept(h, scale))


def _kept(hashes: Column, scale: int) -> Column:
    """Those of ``hashes`` below 1/``scale`` of the range, else the smallest one."""
    below = F.lit(-(1 << 63) + (1 << 64) // scale)
    return _bind(F.filter(hashes, lambda x: x < below), lambda kept: F.when(
        (F.size(kept) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(kept))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds; two empty sketches are alike (1), an empty and another are not (0)."""
    smaller = F.least(F.size(a), F.size(b))
    return (F.when(F.size(a) + F.size(b) == 0, 1.0).when(smaller == 0, 0.0)
            .otherwise(F.size(F.array_intersect(a, b)) / smaller))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two documents together: equal to that of their shingles' union. The
    one hash that a text keeps above the fraction goes as soon as the other has one
    below, and of two such hashes the smaller one stays."""
    return _bind(F.array_union(a, b), lambda h: _kept(h, scale))


def as_text(s: Column) -> Column:
    """16 hex digits per kept hash, ascending."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document with the next
    one in descending ``doc_id`` order, the first after the last.

    ``doc_id`` is numeric; nulls come last, equal ids in order of a hash of their
    texts. Documents are dealt by ranges of their id, so one shuffle brings
    neighbours together; the first document of the following range is looked up
    by a join on the range number.
    """
    chosen = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions_for(chosen, "text")
    cuts = chosen.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    own = (F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)).cast("int")
    ranged = chosen.withColumn("range_no", own).withColumn("tie", F.xxhash64("text"))
    tops = {int(r["range_no"]): r["top"] for r in ranged.groupBy("range_no").agg(F.max("doc_id").alias("top")).collect()}   # one per range
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]

    present = sorted(tops, reverse=True)
    for_range = {after: before for before, after in zip(present, present[1:] + present[:1])}   # range -> the range that its head follows
    ids = [t for t in tops.values() if t is not None]
    is_top = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if len(ids) < len(tops):
        is_top = is_top | F.col("doc_id").isNull()
    first = Window.partitionBy("range_no").orderBy(*order)
    heads = ranged.where(is_top).withColumn("n", F.row_number().over(first)).where("n = 1")
    follows = F.create_map(*[F.lit(x) for pair in for_range.items() for x in pair]) if for_range else F.create_map(F.lit(0), F.lit(0))
    heads = heads.select(F.get(F.array(follows[F.col("range_no")]), 0).alias("range_no"), F.col("text").alias("head_text"), sketch(F.col("text")).alias("head_sketch"))

    sketched = ranged.withColumn("sketch", sketch(F.col("text")))
    lead = sketched.select("doc_id", "text", "sketch", "range_no", F.lead("text").over(first).alias("lead_text"), F.lead("sketch").over(first).alias("lead_sketch"))
    joined = lead.join(heads, "range_no", "left")
    return joined.select("doc_id", "text", "sketch", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_sketch", "head_sketch").alias("next_sketch"))
