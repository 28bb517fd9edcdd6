"""N-gram language model as a weighted backoff automaton, learnt and applied at corpus size.

Model: of order ``order`` (words of context, and the next one), smoothed by
interpolation. A context h seen c(h) times in training is a state. It has an arc for
every word w seen after it, of weight

    P(w | h) = (c(h w) + t(h) * P(w | h')) / (c(h) + t(h)),

and a failure arc to h', which is h without its first word, of weight t(h) / (c(h) + t(h)).
t(h) = c(h)^HEAPS stands for the number of different words after h, as Heaps' law has
it. The root has an arc for every known word (absolute discounting) and one for any
unknown word. A text is walked once from left to right: from the state that the words
before led to, down failure arcs to the first state with an arc for the next word, and
along it to the longest known context. Weights are log10 and add up.

No task sees the whole model. Documents are bundled into chunks. A chunk sends the
n-grams of all lengths that it holds, with its own training counts, to buckets of
n-gram hashes; a bucket adds them up and answers with the totals; the chunk then has
every state and arc that its documents can meet, and walks them. An n-gram is sent once
by a chunk, so no bucket gets more of a frequent one. Counts cover all training
documents; nothing is pruned. N-grams are told apart by ``KEPT_BITS`` bits of hash
within a bucket, which mixes up about one in ten million of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .arrays import NON_BLANK_BYTES, ranges, release, slices, span_hashes, splitmix, words
from .staging import partitions_for, stage

ORDER = 3
HEAPS = 0.7
CHUNK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000    # text whose n-grams meet in one bucket
KEPT_BITS = 44
START, END = np.uint64(1), np.uint64(2)      # word hashes are finalizer outputs; these two stand for the text's bounds
NONE = -1


@dataclass
class Chunk:
    """The chunk's token stream: every text's words between a start and an end.

    ``grams`` are the hashes of its distinct n-grams, ascending, words marked by
    ``mark``; ``gram[m - 1]`` has per token the index of the n-gram of ``m`` tokens that
    ends there, or NONE where the text has fewer (the start alone is none, either).
    ``row`` is the token's document; ``count`` are training counts per n-gram."""
    grams: np.ndarray
    gram: list[np.ndarray]
    row: np.ndarray
    count: np.ndarray


def mark(buckets: int) -> int:
    """The bit of a hash that tells words from longer n-grams: the last one kept."""
    return max(0, 64 - KEPT_BITS - (buckets - 1).bit_length())


def read_chunk(texts: pa.Array, train: np.ndarray, order: int, buckets: int) -> Chunk:
    hashed, n_words = [], []
    for _, data, offsets in slices(pa.record_batch({"text": texts}), "text"):
        low, starts, ends, first = words(data, offsets, NON_BLANK_BYTES)
        hashed.append(span_hashes(low, starts, ends))
        n_words.append(np.diff(first))
    n = np.concatenate([*n_words, np.zeros(0, np.int64)]) + 2
    stop = np.cumsum(n)
    token = np.full(int(stop[-1]) if len(stop) else 0, END, np.uint64)
    token[stop - n] = START
    token[ranges(stop - n + 1, n - 2)] = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    place = ranges(np.zeros(len(n), np.int64), n)                 # in the text, the start being 0
    row = np.repeat(np.arange(len(n)), n)
    bit = np.uint64(1 << mark(buckets))
    levels, held = [], []
    code = splitmix(token)
    for m in range(1, order + 1):
        if m > 1:
            code = splitmix(np.concatenate([code[:1], code[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + token)
        valid = place >= (1 if m == 1 else m - 1)
        levels.append((code[valid] | bit) if m == 1 else (code[valid] & ~bit))
        held.append(np.flatnonzero(valid))
    grams, index = np.unique(np.concatenate(levels), return_inverse=True)
    known = train[row]
    gram, count, at = [], np.zeros(len(grams), np.int64), 0
    for valid in held:
        own = index[at:at + len(valid)]
        gram.append(np.full(len(token), NONE, np.int64))
        gram[-1][valid] = own
        count += np.bincount(own[known[valid]], minlength=len(grams))
        at += len(valid)
    return Chunk(grams, gram, row, count)


def bucket_bounds(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the ascending ``grams`` begins (one more at the end)."""
    own = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each byte by byte of its values, compressed; ``_spread`` gives them back."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    head = np.array([len(raw), *[len(a) for a in arrays]], "<i8").tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def _spread(blob: bytes, *types: str) -> list[np.ndarray]:
    head = np.frombuffer(blob, "<i8", 1 + len(types))
    raw = pa.decompress(memoryview(blob)[8 * len(head):], int(head[0]), "zstd", asbytes=True)
    out, at = [], 0
    for n, t in zip(head[1:], types):
        size = int(n) * np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(-1, int(n)) if n else np.zeros((np.dtype(t).itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += size
    return out


def bundle(docs: DataFrame, train: Column, doc_id: str, text: str) -> DataFrame:
    """(chunk, doc_ids, train, texts): each task's documents in order, about
    CHUNK_BYTES of text to a row, compressed."""
    chosen = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    id_type = chosen.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("texts", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0].column(0) for x in held])
            known = pa.concat_arrays([x[0].column(2) for x in held])
            lengths = np.concatenate([np.diff(x[2]) for x in held])
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([whole(ids), whole(known), pa.array([_squeeze(lengths, np.concatenate([x[1] for x in held]))], pa.binary())],
                                              names=["doc_ids", "train", "texts"])

        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                if held and size + len(data) > CHUNK_BYTES:
                    yield close()
                    held, size = [], 0
                held.append((rows, data.copy(), offsets))
                size += len(data)
        if held:
            yield close()

    return chosen.mapInArrow(gather, schema).select(F.monotonically_increasing_id().alias("chunk"), "*")


def _texts(blob: bytes) -> pa.Array:
    lengths, data = _spread(blob, "<i8", "u1")
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))


def _add_up(table: pa.Table) -> pa.Table:
    """One bucket: each chunk's n-grams with their totals, in the chunk's order; and, with
    a null chunk, how often words occur, how many there are, and how many once and twice."""
    grams, counts = [], []
    for blob in table.column("grams").to_pylist():
        step, n = _spread(blob, "<u8", "<u4")
        grams.append(np.cumsum(step, dtype=np.uint64))
        counts.append(n)
    sizes = [len(g) for g in grams]
    distinct, group = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(group, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    of_words = total[(distinct & np.uint64(1)) == 1]
    stats = [int(of_words.sum()), int((of_words > 0).sum()), int((of_words == 1).sum()), int((of_words == 2).sum())]
    ends = np.cumsum(sizes)
    answers = [_squeeze(total[group[end - size:end]].astype("<u8")) for end, size in zip(ends, sizes)]
    release()
    return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
                     "answer": pa.array([*answers, None], pa.binary()), "stats": pa.array([*[None] * len(answers), stats], pa.list_(pa.int64()))})


@dataclass
class Totals:
    """What every chunk needs to know of the whole training corpus."""
    tokens: int                 # N
    types: int                  # V
    word_discount: float


def _totals(answers: DataFrame) -> Totals:
    tokens, types, once, twice = (x or 0 for x in answers.agg(*[F.sum(F.col("stats")[i]) for i in range(4)]).first())
    return Totals(tokens, types, min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5)))


class Automaton:
    """The states and arcs that a chunk's texts can meet, from the total counts of its n-grams."""

    def __init__(self, chunk: Chunk, total: np.ndarray, training_texts: int, totals: Totals):
        self.chunk, self.order, self.totals = chunk, len(chunk.gram), totals
        counted = np.append(total, 0)                               # NONE is the last one
        self.seen = [counted[g] for g in chunk.gram]                # per n-gram length and token
        # A context of m words ends at the token before; the start of a text is one of one word.
        starts = np.append(True, chunk.row[1:] != chunk.row[:-1]) if len(chunk.row) else np.zeros(0, bool)
        self.token = np.flatnonzero(~starts)
        self.context = [np.where(starts, training_texts, self.seen[0])[self.token - 1], *[s[self.token - 1] for s in self.seen[1:-1]]]
        self.seen = [s[self.token] for s in self.seen]

    def arcs(self) -> list[np.ndarray]:
        """Per token, the probability of its word after 0, 1, 2, ... words of context."""
        n = self.seen[0]
        if not self.totals.tokens:
            return [np.ones(len(n))] * self.order
        unknown = self.totals.word_discount * self.totals.types
        out = [np.where(n > 0, n - self.totals.word_discount, unknown) / self.totals.tokens]
        for context, seen in zip(self.context, self.seen[1:]):
            kinds = context.astype(float) ** HEAPS
            out.append(np.where(context > 0, (seen + kinds * out[-1]) / np.maximum(context + kinds, 1), out[-1]))
        return out

    def walk(self) -> np.ndarray:
        """Per token, the weight of the failure arcs and of the arc that it takes. The state
        that a token starts from is the longest known context, which is where the arc of
        the token before has led to."""
        probability = self.arcs()
        state = np.sum([c > 0 for c in self.context], axis=0) if self.context else np.zeros(len(self.token), np.int64)
        weight, done = np.zeros(len(self.token)), np.zeros(len(self.token), bool)
        for length in range(self.order - 1, 0, -1):
            here = (state == length) & ~done
            arc = here & (self.seen[length] > 0)
            weight[arc] += np.log10(probability[length][arc])
            done |= arc
            falls = here & ~arc
            context = self.context[length - 1][falls].astype(float)
            weight[falls] += np.log10(context ** HEAPS / (context + context ** HEAPS))
            state[falls] = length - 1
        at_root = ~done
        weight[at_root] += np.log10(probability[0][at_root])
        return weight

    def scores(self, n_rows: int) -> dict[str, np.ndarray]:
        """Per document: tokens, known tokens, base and model log10 probability."""
        row, n, t = self.chunk.row[self.token], self.seen[0], self.totals
        add = lambda x: np.bincount(row, x, minlength=n_rows)
        return {"n_tokens": np.bincount(row, minlength=n_rows), "n_known": add(n > 0).astype(np.int64), "train_tokens": np.full(n_rows, t.tokens, np.int64),
                "base_score": add(np.log10((n + 1) / (t.tokens + t.types + 1))), "score": add(self.walk())}


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, train BOOLEAN, n_tokens, n_known, train_tokens LONG, base_score, score DOUBLE) per
    row of ``docs``: the log10 probability of each text by a model of the texts for
    which ``train`` (a condition on ``docs``; null counts as true) holds.

    Words are runs of non-blank characters, A-Z lower-cased; each text ends with one
    end token. A null text is empty (the end token alone). Rows are independent, so
    repeated rows and null ids have rows of their own. Without training documents every
    token is unknown, at probability 1. Other columns are left out.
    """
    if order < 1:
        raise ValueError(f"a model of order {order} has no words")
    buckets = partitions_for(docs, text, BUCKET_BYTES)
    chunks = stage(bundle(docs, train, doc_id, text), "lm-chunks")
    training_texts = chunks.select(F.sum(F.size(F.filter("train", lambda x: x)).cast("long"))).first()[0] or 0

    def read(texts: bytes, known: pa.Array) -> Chunk:
        return read_chunk(_texts(texts), np.asarray(known.to_numpy(zero_copy_only=False), bool), order, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                c = read(batch.column(2)[i].as_py(), batch.column(1)[i].values)
                first = bucket_bounds(c.grams, buckets)
                kept, held = c.grams >> np.uint64(mark(buckets)), np.flatnonzero(np.diff(first))
                blobs = [_squeeze(np.diff(kept[first[b]:first[b + 1]], prepend=np.uint64(0)).astype("<u8"), c.count[first[b]:first[b + 1]].astype("<u4")) for b in held]
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([batch.column(0)[i].as_py()] * len(held), pa.int64()), pa.array(blobs, pa.binary())],
                                                 names=["bucket", "chunk", "grams"])
                release()

    sent = chunks.select("chunk", "train", "texts").mapInArrow(count, "bucket int, chunk long, grams binary").repartition(buckets, "bucket")
    answers = stage(sent.groupBy("bucket").applyInArrow(_add_up, "chunk long, bucket int, answer binary, stats array<long>"), "lm-answers")
    totals = _totals(answers)                                       # four numbers

    id_type = chunks.schema["doc_ids"].dataType.elementType
    names = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("train", T.BooleanType()), *[T.StructField(n, T.LongType() if t == pa.int64() else T.DoubleType()) for n, t in names.items()]])

    def apply(own: pa.Table, answered: pa.Table) -> pa.Table:
        blobs = [b for _, b in sorted(zip(answered.column("bucket").to_pylist(), answered.column("answer").to_pylist()))]
        total = np.concatenate([np.zeros(0, np.int64), *[_spread(b, "<u8")[0].astype(np.int64) for b in blobs]])
        out = [pa.schema([("doc_id", own.schema.field("doc_ids").type.value_type), ("train", pa.bool_()), *names.items()]).empty_table()]
        for i in range(len(own)):
            ids, known = own.column("doc_ids")[i].values, own.column("train")[i].values
            c = read(own.column("texts")[i].as_py(), known)
            scored = Automaton(c, total, training_texts, totals).scores(len(ids))
            out.append(pa.table({"doc_id": ids, "train": known, **{n: scored[n] for n in names}}))
        release()
        return pa.concat_tables(out)

    texts = chunks.select("chunk", "doc_ids", "train", "texts").groupBy("chunk")
    return texts.cogroup(answers.where("chunk is not null").select("chunk", "bucket", "answer").groupBy("chunk")).applyInArrow(apply, schema)
