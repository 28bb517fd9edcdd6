"""The registered queries: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fingerprints, lexical_search, lm_scoring, toxicity
from .decontamination import mark_passages
from .hard_negatives import hard_negatives
from .lists import BLOCKED_HOSTS, URL_RULES
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .packing import best_fit_pack, token_pieces
from .sharding import TABLE_SIZE, place
from .staging import new_folder
from .token_counts import token_counts
from .token_store import read_store, write_store
from .top_k_search import top_k
from .url_filter import judge_urls

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 2048
TOKEN_LIMIT = 1024
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, in pieces packed into 2048-token sequences."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(digests, SEQUENCE_TOKENS)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a model of those not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scored = lm_scoring.score(docs, remainder != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the blocked hosts."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to a bit-packed store and read back from it."""
    path = new_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside passages of 10 words of a benchmark item."""
    marked = mark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                         F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and whether it is over 1024."""
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


ARROW_ROWS = 2_000     # documents in one Arrow batch, where the session has Spark's default of 10,000


def prepare(spark: SparkSession) -> None:
    """Readies a session for Python workers: they can import this package from
    where the driver found it (a cluster has it installed, or gets it by
    ``--py-files``), and get whole documents in smaller batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)
    return run


def learns_labels(doc_id: str = "doc_id") -> Column:
    """Documents whose labels may be learnt from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def toxicity_weights(docs: DataFrame, sf_dir: str) -> toxicity.Weights:
    return toxicity.train(docs, table(docs.sparkSession, sf_dir, "labels"), "toxic", learns_labels())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by weights learnt from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_column(docs, toxicity_weights(docs, sf_dir))
    return scored.select("doc_id", F.coalesce(~learns_labels(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class, named by its smallest doc_id."""
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_representative"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot in the lookup table and its shard, of 64."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, TABLE_SIZE)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, that of its edited text (its second half replaced
    from the next document), and how alike they and the next one's are."""
    paired = fingerprints.with_next(table(spark, sf_dir, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    edited = edited.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                         fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                         fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents that match every benchmark item best."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors of highest inner product for every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_url_filters": op3_url_filters,
    "op4_token_store": op4_token_store,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_fingerprints": op10_fingerprints,
    "op11_lexical_search": op11_lexical_search,
    "op12_top_k_search": op12_top_k_search,
    "op13_hard_negatives": op13_hard_negatives,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _registered(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
