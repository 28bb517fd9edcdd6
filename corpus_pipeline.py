"""The corpus pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame; it is written as Parquet and read back as the next stage's ``docs``. All
stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlane.llm.decontamination import drop_contaminated
from marketlane.llm.near_dedup import keep_one
from marketlane.llm.packing import best_fit_pack, token_pieces
from marketlane.llm.queries import SEQUENCE_TOKENS, prepare, table, tokenizer_path, toxicity_weights
from marketlane.llm.staging import stage
from marketlane.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more; the rest stay, empty ones too."""
    prepare(spark)
    return drop_toxic(docs, toxicity_weights(docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of the smallest doc_id."""
    prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    prepare(spark)
    pieces = token_pieces(docs, tokenizer_path(), SEQUENCE_TOKENS)
    return best_fit_pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Learnt scores, banding and tokenizers are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
