"""Ranked lexical search over hashed max-sketches.

The index is made once, whatever the queries: per document its number of terms, its
distinct terms (as 64-bit hashes, sorted) with their counts, and a sketch. A sketch
has a power of two of one-byte cells, at least four for each distinct term. Every
term falls on two cells, and a cell keeps the largest count that fell on it. As a
term's impact grows with its count, the smaller of a term's two cells gives an upper
bound of its impact in the document: never too low, and 0 for most terms that the
document does not hold.

Queries come in blocks. For a batch of documents one lookup of the block's terms in
the sketches gives each (query, document) its upper bound. Documents are then scored
exactly by descending bound until no bound reaches the query's k-th best score (the
floor). A first pass scores only each task's best-bounded documents, to give all
tasks of the second a high floor to start from; the second covers all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from .arrays import binaries, ranges, release, slices, span_hashes, splitmix, words
from .best_rows import BestRows
from .staging import pick, stage
from .vectors import in_blocks, query_blocks

BLOCK_TERMS = 100_000       # (query, term) pairs of one block of queries
HELD_VALUES = 4_000_000     # (document, query term) values that a task holds at once
CELLS_PER_TERM = 4
MOST = 255                  # a cell's largest count, which stands for any higher one too
IMPACT_LIMIT = 1_000_000    # no count reaches this impact


def term_lists(df: DataFrame, id: str, text: str, sketched: bool) -> DataFrame:
    """(id, n long, terms binary, counts binary, and sketch binary if ``sketched``)
    per row that holds a term: runs of the bytes 0-9, A-Z (lower-cased), a-z and
    of all characters from U+0080. Terms are uint64 hashes in ascending order, counts uint32."""
    chosen = pick(df, id=id, text=text)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                low, starts, ends, first = words(data, offsets)
                hashed, total = span_hashes(low, starts, ends), np.diff(first)
                row = np.repeat(np.arange(len(rows)), total)
                order = np.lexsort((hashed, row))
                hashed, row = hashed[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                terms, row, count = hashed[at], row[at], np.diff(np.append(at, len(new)))
                held = np.flatnonzero(total)
                bounds = np.append(np.searchsorted(row, held), len(row))
                columns = {"id": rows.column(0).take(pa.array(held)), "n": pa.array(total[held].astype(np.int64)),
                           "terms": binaries(terms, bounds), "counts": binaries(count.astype(np.uint32), bounds)}
                if sketched:
                    columns["sketch"] = sketches(terms, count, bounds)
                yield pa.RecordBatch.from_pydict(columns)
        release()

    schema = [chosen.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    return chosen.mapInArrow(lists, T.StructType(schema + [T.StructField("sketch", T.BinaryType())] * sketched))


def cells(terms: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each term in a sketch of 2^bits cells."""
    down = (64 - np.asarray(bits)).astype(np.uint64)
    return (terms >> down).astype(np.int64), (splitmix(terms) >> down).astype(np.int64)


def sketches(terms: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One max-sketch for each ``terms[bounds[i]:bounds[i + 1]]``."""
    distinct = np.diff(bounds)
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(distinct, 1) * CELLS_PER_TERM))).astype(np.int64)
    ends = np.cumsum(1 << bits)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    start, value = np.repeat(ends - (1 << bits), distinct), np.minimum(count, MOST).astype(np.uint8)
    for at in cells(terms, np.repeat(bits, distinct)):
        np.maximum.at(out, start + at, value)
    return binaries(out, np.append(0, ends))


def impact(count, m):
    """A term's impact in a document, in whole numbers, rounded down."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``k`` best documents of a score above 0: (item_id, rank, doc_id, score).

    With N documents that hold a term, L terms in all, n in the document and df
    documents of a term: the term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))),
    a document's m is 25 + (75 * n * N) div L, a count's impact (10^9 * count) div
    (1000 * count + 8 * m), and a score the sum of weight * impact over the item's
    terms, repeats included. Ties go to the smaller doc_id, null ids last.

    A null text is empty; rows without terms have no place. Every row of ``docs`` is a
    document and every row of ``items`` a query of its own, also where rows or ids
    repeat or an id is null. A term is known by a 64-bit hash. Other columns are left out."""
    spark = docs.sparkSession
    index = stage(term_lists(docs, doc_id, text, True), "term-sketches")
    queries = stage(term_lists(items, item_id, item_text, False), "query-terms")
    documents, length = index.agg(F.count("*"), F.sum("n")).first()
    result = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    empty = spark.createDataFrame([], result)
    pairs = queries.agg(F.sum(F.octet_length("terms"))).first()[0]
    if not documents or not pairs:
        return empty

    def answer(block: pa.Table) -> DataFrame:
        held = Block(block, documents, length)
        found = document_counts(index, held.terms)
        held.weigh(found)
        none = np.zeros(len(block), np.int64)
        floors = none.copy()
        for query, score in best_documents(index, held, none, k, 1).where(F.col("rank") == k).select("query", "score").toLocalIterator():
            floors[query] = score
        found = best_documents(index, held, floors, k, None)
        names = spark.createDataFrame(pa.table({"query": np.arange(len(block)), "item_id": block.column("id")}))
        return found.join(F.broadcast(names), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")

    return in_blocks(query_blocks(queries.select("id", "terms", "counts"), pairs // 8, BLOCK_TERMS), answer, "lexical-search", empty)


class Block:
    """A block of queries: its distinct terms, sorted, and one entry for each (query,
    term), by query. Broadcast; its size is bounded by ``BLOCK_TERMS``."""

    def __init__(self, block: pa.Table, documents: int, length: int):
        self.documents, self.length = documents, length
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("terms")]
        self.repeats = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in block.column("counts")]).astype(np.int64)
        self.terms, self.entry = np.unique(np.concatenate(lists), return_inverse=True)
        self.first = np.cumsum([0] + [len(x) for x in lists])

    def weigh(self, counts: np.ndarray) -> None:
        """Takes the terms' document counts."""
        weights = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(df) + 1))) for df in counts], np.int64)
        self.weight = weights[self.entry] * self.repeats

    def length_terms(self, n: np.ndarray) -> np.ndarray:
        """Each document's m; in Python's numbers, as 75 * n * N can pass 64 bits."""
        return np.array([25 + 75 * int(x) * self.documents // self.length for x in n], np.int64)


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """The number of documents that hold each of ``terms``."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            found, _ = values_of(batch.column(0), np.uint64)
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            total += np.bincount(at[own[at] == found], minlength=len(own))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held), "df": pa.array(total[held])})
        release()

    out = np.zeros(len(terms), np.int64)
    for term, df in index.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[term] = df
    return out


def values_of(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's begin (one more at the end)."""
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data[at[0]:at[-1]].tobytes(), kind), (at - at[0]) // size


def best_documents(index: DataFrame, held: Block, floors: np.ndarray, k: int, rounds: int | None) -> DataFrame:
    """(query, rank, id, score): each query's best ``k`` documents that reach its
    floor. With ``rounds``, only so many times the ``k`` best-bounded documents of
    each slice are scored."""
    shared = index.sparkSession.sparkContext.broadcast((held, floors))
    id_type = index.schema["id"].dataType

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = shared.value
        kept, rows = None, max(16, HELD_VALUES // (len(own.entry) + len(own.first)))
        for batch in batches:
            kept = kept or BestRows(k, least, batch.schema.field(0).type)
            for first in range(0, len(batch), rows):
                fold(own, kept, batch.slice(first, rows), k, rounds)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept.group), kept.id, pa.array(kept.score)], names=["query", "id", "score"])
        release()

    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    found = index.select("id", "n", "sketch", "terms", "counts").mapInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def upper_bounds(own: Block, sketch: pa.Array, m: np.ndarray) -> np.ndarray:
    """An upper bound of every (document, query)'s score, from one lookup of the block's terms."""
    impacts = impact(np.arange(MOST + 1)[None, :], m[:, None])
    impacts[:, MOST] = IMPACT_LIMIT
    data, at = values_of(sketch, np.uint8)
    widths = np.diff(at)
    out = np.zeros((len(m), len(own.first) - 1), np.int64)
    for width in np.unique(widths):
        these = np.flatnonzero(widths == width)
        table = data[at[these][:, None] + np.arange(width)]
        one, two = cells(own.terms, np.full(1, int(width).bit_length() - 1))
        count = np.minimum(table[:, one], table[:, two])[:, own.entry]
        out[these] = np.add.reduceat(np.take_along_axis(impacts[these], count.astype(np.int64), axis=1) * own.weight, own.first[:-1], axis=1)
    return out


def fold(own: Block, kept: BestRows, batch: pa.RecordBatch, k: int, rounds: int | None) -> None:
    """A slice of documents against all queries of the block."""
    m = own.length_terms(batch.column(1).to_numpy())
    bounds = upper_bounds(own, batch.column(2), m)
    doc, query = np.nonzero((bounds >= kept.floor) & (bounds > 0))
    order = np.lexsort((-bounds[doc, query], query))
    doc, query = doc[order], query[order]
    bound = bounds[doc, query]
    (terms, first), (counts, _) = values_of(batch.column(3), np.uint64), values_of(batch.column(4), np.uint32)
    done = 0
    while len(doc) and done != rounds:
        now = np.arange(len(query)) - np.searchsorted(query, query) < k
        score = exact_scores(own, doc[now], query[now], m, terms, counts, first)
        good = score > 0
        kept.add(query[now][good], score[good], batch.column(0).take(pa.array(doc[now][good])))
        later = ~now & (bound >= kept.floor[query])
        doc, query, bound = doc[later], query[later], bound[later]
        done += 1


def exact_scores(own: Block, doc: np.ndarray, query: np.ndarray, m: np.ndarray, terms: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of (document, query) pairs, from the documents' term lists."""
    size = own.first[query + 1] - own.first[query]
    entry, holder = ranges(own.first[query], size), np.repeat(doc, size)
    wanted = own.terms[own.entry[entry]]
    low, end = first[holder], first[holder + 1]
    high = end.copy()
    while (low < high).any():                       # bisection in each document's own list
        middle = (low + high) // 2
        below = (low < high) & (terms[np.minimum(middle, len(terms) - 1)] < wanted)
        low, high = np.where(below, middle + 1, low), np.where(below | (low >= high), high, middle)
    at = np.minimum(low, len(terms) - 1)
    count = np.where((low < end) & (terms[at] == wanted), counts[at].astype(np.int64), 0)
    value = impact(count, m[holder]) * own.weight[entry]
    return np.add.reduceat(value, np.cumsum(size) - size)
