"""Near-duplicate classes by ProbMinHash, banding and verification.

A text's 5-word shingles, weighted from 1 (once) to below 1 1/8 (often), get exponential arrival times
of a Poisson process each; every arrival falls on a random register, which keeps
its first one. Shingles stop as soon as their next arrival comes after the last
register's (early termination). Two registers agree with the probability Jaccard
similarity of the texts. Texts that agree in all registers of a band meet in a
bucket.

Nodes are different texts, so exact copies are one node from the start. Links are
found without writing out the pairs of a bucket:

1. every member of a bucket with the bucket's hub (its smallest key);
2. where a bucket still holds several components, a few members of each with each other;
3. where it still does, the members outside its largest component with all others,
   but for the pairs that step 2 has compared.

Steps 2 and 3 deal a bucket's members into blocks and let two blocks meet in a
group, each pair of blocks that has something to compare in one of its own. A group
holds about ``SPLIT_BYTES`` of shingles at most, however many texts a bucket has.

A link needs the Jaccard similarity of the sets of shingles (as 32-bit hashes) to
reach the threshold. Step 1 drops candidates whose registers agree too rarely and
compares the others pair by pair; steps 2 and 3 find candidates by an inverted list
of each member's rarest shingles inside the group, compare these exactly, and write
out one link per member and component.
After step 3 every two texts that share a bucket are in one component or were
compared. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .arrays import binaries, ranges, release, row_shingles, slices, span_hashes, splitmix, words
from .staging import pick, stage

WIDTH = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 4
REGISTERS = BANDS * BAND_ROWS
# Sets alike at 0.8 have a weighted similarity of LOWEST at least, whatever one text
# repeats and the other does not: no term of its sums grows by more than MOST_WEIGHT.
# Such a pair misses all bands with a probability below (1 - LOWEST^4)^20 = 0.3 %.
MOST_WEIGHT = 1.125
LOWEST = SIMILARITY / MOST_WEIGHT
# Registers agree with a standard deviation of 0.051 at LOWEST; four of these below.
LEAST_AGREEMENT = LOWEST - 4 * (LOWEST * (1 - LOWEST) / REGISTERS) ** 0.5
MEMBERS_OF_COMPONENT = 8        # tried in step 2
SPLIT_BYTES = 8_000_000         # shingles that one group of steps 2 and 3 holds
MAIN, OTHER, OTHER_TRIED, MAIN_TRIED = range(4)     # kinds of blocks: in the largest component or not, compared in step 2 or not
MEETINGS = [(MAIN, OTHER), (MAIN, OTHER_TRIED), (OTHER, OTHER), (OTHER, OTHER_TRIED), (OTHER, MAIN_TRIED)]
BROADCAST_KEYS = 500_000        # 16-byte keys: up to 8 MB are broadcast, more are joined by a shuffle
SLICE = 2_000_000


def row_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), each pair once, by row and hash."""
    low, starts, ends, first = words(data, offsets)
    h, row = row_shingles(span_hashes(low, starts, ends), first, WIDTH)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(h)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """ProbMinHash of weighted elements: per row and register the (32-bit) element
    that arrived first. Rows without elements have zeros."""
    time = np.full(n_rows * REGISTERS, np.inf)
    first = np.zeros(n_rows * REGISTERS, np.uint32)
    last = np.full(n_rows, np.inf)
    arrival = np.zeros(len(element))
    step = 0
    while len(element):
        random = splitmix(element + np.uint64((2 * step + 1) * 0xD1342543DE82EF95 % 2**64))
        arrival = arrival - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        register = row * REGISTERS + (splitmix(random + np.uint64(1)) % np.uint64(REGISTERS)).astype(np.int64)
        better = np.flatnonzero(arrival < time[register])
        order = better[np.argsort(arrival[better], kind="stable")]
        at, which = np.unique(register[order], return_index=True)
        time[at], first[at] = arrival[order[which]], (element[order[which]] >> np.uint64(32)).astype(np.uint32)
        changed = np.unique(at // REGISTERS)
        last[changed] = time.reshape(n_rows, REGISTERS)[changed].max(axis=1)
        alive = arrival < last[row]
        row, element, weight, arrival = row[alive], element[alive], weight[alive], arrival[alive]
        step += 1
    return first.reshape(n_rows, REGISTERS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE):
            row, element, n = row_elements(data, offsets)
            signed = signatures(row, element, MOST_WEIGHT - (MOST_WEIGHT - 1) / n, len(rows))
            has_words = np.bincount(row, minlength=len(rows)) > 0
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(has_words), binaries(signed.reshape(-1), np.arange(len(rows) + 1) * REGISTERS)],
                                             names=["doc_id", "key", "has_words", "signature"])
    release()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE):
            row, element, _ = row_elements(data, offsets)
            short = (element >> np.uint64(32)).astype(np.uint32)        # ascending within a row
            yield pa.RecordBatch.from_arrays([rows.column(0), binaries(short, np.searchsorted(row, np.arange(len(rows) + 1)))], names=["key", "shingles"])
    release()


def _agreement(signature: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (signature == others).mean(axis=-1)


def _as_signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(-1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose registers agree often enough."""
    for batch in batches:
        keep = _agreement(_as_signatures(batch.column(2)), _as_signatures(batch.column(3))) >= LEAST_AGREEMENT
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                keep.append(False)
                continue
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release()


def _linked(table: pa.Table) -> pa.Table:
    """Of one meeting of two blocks (or of a block with itself), a link from each
    member of the left one to every other component that has a similar member in
    the right one. Similar sets share one of the rarest shingles of each."""
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)      # 0: both
    a, b = [], []
    if len(left) and len(right):
        keys = table.column("key").to_pylist()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sets = [np.unique(np.frombuffer(x, np.uint32)) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        bounds = np.append(0, np.cumsum(size))
        shingles, term = np.unique(np.concatenate(sets), return_inverse=True)
        rank = np.empty(len(shingles), np.int64)
        rank[np.argsort(np.bincount(term, minlength=len(shingles)), kind="stable")] = np.arange(len(shingles))
        term = rank[term]
        term = term[np.lexsort((term, np.repeat(np.arange(len(sets)), size)))]          # of each set, the rarest first
        prefix = size - np.ceil(SIMILARITY * size).astype(np.int64) + 1
        filed = term[ranges(bounds[right], prefix[right])]
        holders = np.repeat(right, prefix[right])[np.argsort(filed, kind="stable")]
        n = np.bincount(filed, minlength=len(shingles))
        first = np.cumsum(n) - n
        own = np.zeros(len(shingles), np.int8)
        for i in left:
            rare = term[bounds[i]:bounds[i] + prefix[i]]
            met = np.zeros(len(sets), bool)
            met[holders[ranges(first[rare], n[rare])]] = True
            met &= (label != label[i]) & (np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i]))
            if side[i] == 0:
                met[:i + 1] = False
            js = np.flatnonzero(met)
            if len(js):
                own[term[bounds[i]:bounds[i + 1]]] = 1
                both = np.add.reduceat(own[term[ranges(bounds[js], size[js])]], np.cumsum(size[js]) - size[js], dtype=np.int64)
                own[term[bounds[i]:bounds[i + 1]]] = 0
                similar = js[both >= SIMILARITY * (size[i] + size[js] - both)]
                for j in similar[np.unique(label[similar], return_index=True)[1]]:
                    a.append(min(keys[i], keys[j]))
                    b.append(max(keys[i], keys[j]))
    del table
    release()
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _meetings(members: DataFrame) -> DataFrame:
    """(bucket, key, label, blocks, side) from (bucket, key, label, kind, size): a row
    for each meeting of ``MEETINGS`` that a member's block takes part in. ``side`` is -1
    in the left block, 1 in the right one, 0 where a block meets itself."""
    counts = members.groupBy("bucket").agg(*[F.ceil(F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)) / (SPLIT_BYTES // 4)).cast("int").alias(f"n{k}") for k in range(4)])
    own_count = F.element_at(F.array(*[F.col(f"n{k}") for k in range(4)]), F.col("kind") + 1)
    placed = members.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), own_count).cast("int"))
    others = lambda k: F.when(F.col(f"n{k}") > 0, F.sequence(F.lit(0), F.col(f"n{k}") - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(x: int, y: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.array(F.lit(x), i, F.lit(y), j).alias("blocks"), side.cast("int").alias("side"))

    own = F.col("block")
    none = F.array().cast("array<struct<blocks:array<int>,side:int>>")
    all_of = []
    for k in range(4):
        parts = []
        for x, y in MEETINGS:
            if x == y == k:
                parts.append(F.transform(others(k), lambda j: meeting(k, k, F.least(own, j), F.greatest(own, j), F.signum(own - j))))
            elif x == k:
                parts.append(F.transform(others(y), lambda j: meeting(x, y, own, j, F.lit(-1))))
            elif y == k:
                parts.append(F.transform(others(x), lambda j: meeting(x, y, j, own, F.lit(1))))
        all_of.append(F.when(F.col("kind") == k, F.concat(*parts)))
    return placed.select("bucket", "key", "label", F.explode(F.coalesce(*all_of, none)).alias("m")).select("bucket", "key", "label", "m.blocks", "m.side")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each linked key's connected component.

    Smallest labels spread along links and along labels (pointer jumping) until
    nothing changes; each round is written and read back.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-links")
    labels = stage(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("label")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = lower.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stage(new.withColumn("changed", F.col("old") != F.col("label")), "dedup-labels")
        labels = new.select("key", "label")
        if new.where("changed").isEmpty():
            return labels


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    chosen = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chosen.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def _small(keys: DataFrame) -> DataFrame:
    """``keys`` (staged), marked for broadcast if there are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key BINARY, class_id, class_key BINARY): one row per row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the class, ``class_key`` the key of a
    text with it, ``key`` the MD5 of the row's text. Equal texts are one class, null
    texts being empty; a text without words is alike to equal texts only. Null ids
    count as larger than any other.
    """
    keyed = _keyed(docs, doc_id, text)
    signed_schema = T.StructType([T.StructField("doc_id", keyed.schema["doc_id"].dataType), T.StructField("key", T.BinaryType()),
                                  T.StructField("has_words", T.BooleanType()), T.StructField("signature", T.BinaryType())])
    signed = stage(keyed.mapInArrow(_sign, signed_schema), "dedup-signed")
    nodes = stage(signed.where("has_words").groupBy("key").agg(F.first("signature").alias("signature")), "dedup-nodes")

    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("signature"), b * BAND_ROWS * 4 + 1, F.lit(BAND_ROWS * 4)), b))
    rows = nodes.select("key", F.explode(bucket).alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub != top").select("bucket", "hub")
    members = stage(rows.join(hubs, "bucket"), "dedup-members")

    met = stage(members.select("key").distinct(), "dedup-met")
    texts = keyed.select("key", "text").join(_small(met), "key", "left_semi").dropDuplicates(["key"])
    sets = stage(texts.mapInArrow(_shingle_sets, "key binary, shingles binary").withColumn("size", F.octet_length("shingles").cast("long")), "dedup-sets")

    def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        first = pairs.join(table.select(F.col("key").alias("a"), F.col(value).alias("of_a")), "a")
        return first.join(table.select(F.col("key").alias("b"), F.col(value).alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def verify(pairs: DataFrame) -> DataFrame:
        return stage(with_both(pairs, sets, "shingles").mapInArrow(_verified, "a binary, b binary"), "dedup-verified")

    def labelled(links: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components."""
        with_label = members.join(components(links), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
        with_label = stage(with_label, "dedup-labelled")
        open_ = with_label.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("bucket")
        return with_label.join(open_, "bucket", "left_semi")

    def linked(chosen: DataFrame) -> DataFrame:
        """Links between the components of each bucket, of the pairs that are to meet."""
        met = _meetings(chosen).join(sets.select("key", "shingles"), "key")
        return met.groupBy("bucket", "blocks").applyInArrow(_linked, "a binary, b binary").distinct()

    def with_size(chosen: DataFrame) -> DataFrame:
        return chosen.join(sets.select("key", "size"), "key")

    # 1. Hubs.
    star = members.where("key != hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = verify(stage(with_both(star, nodes, "signature").mapInArrow(_likely, "a binary, b binary"), "dedup-pairs"))

    # 2. A few members of each component.
    some = labelled(links).groupBy("bucket", "label").agg(*[F.min(F.struct(F.xxhash64("key", F.lit(j)).alias("order"), "key")).alias(f"m{j}") for j in range(MEMBERS_OF_COMPONENT)])
    some = some.select("bucket", "label", F.explode(F.array_distinct(F.array(*[F.col(f"m{j}.key") for j in range(MEMBERS_OF_COMPONENT)]))).alias("key"))
    some = stage(with_size(some).withColumn("kind", F.lit(OTHER)), "dedup-some")
    links = stage(links.union(linked(some)), "dedup-linked")

    # 3. Everything left, but for pairs within the largest component and pairs of step 2.
    left = stage(with_size(labelled(links)).join(some.select("bucket", "key", F.lit(True).alias("tried")), ["bucket", "key"], "left"), "dedup-left")
    volume = left.groupBy("bucket", "label").agg(F.sum("size").alias("volume"))
    main = volume.groupBy("bucket").agg(F.max(F.struct("volume", "label")).alias("main")).select("bucket", F.col("main.label").alias("main"))
    kind = F.when(F.col("label") == F.col("main"), F.when(F.col("tried"), MAIN_TRIED).otherwise(MAIN)).otherwise(F.when(F.col("tried"), OTHER_TRIED).otherwise(OTHER))
    links = stage(links.union(linked(left.join(main, "bucket").select("bucket", "key", "label", kind.alias("kind"), "size"))), "dedup-linked")

    labels = components(links)
    placed = signed.select("doc_id", "key").join(labels, "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))
    placed = stage(placed, "dedup-placed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = placed.groupBy("label").agg(F.min(order).alias("best")).select("label", F.col("best.doc_id").alias("class_id"), F.col("best.key").alias("class_key"))
    return placed.join(classes, "label").select("doc_id", "key", "class_id", "class_key")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all its columns, with one row of each near-duplicate class: that of
    the smallest ``doc_id`` (of equal rows of it, any one).

    Null texts are empty, so rows of one id, one with a null and one with an empty text,
    are equal rows. A null id is an id of its own, larger than any other. An empty table stays empty."""
    classes = stage(near_duplicates(docs, doc_id, text), "dedup-classes")
    kept_text = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    # Rows to leave out, by id and text; the ids that occur twice need a closer look.
    drop = stage(classes.where(~kept_text).select("doc_id", "key").distinct(), "dedup-gone")
    twice = stage(classes.where(kept_text).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key"), "dedup-twice")
    own_id, own_key = docs[doc_id], F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    on = lambda t: own_id.eqNullSafe(t["doc_id"]) & (own_key == t["key"])
    kept = docs.join(_small(drop), on(drop), "left_anti")
    if twice.isEmpty():
        return kept
    # A repeated row: one of its equals, whole.
    once = kept.join(twice, on(twice), "left_anti")
    again = kept.join(twice, on(twice), "left_semi").groupBy(own_id, own_key).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return once.unionByName(again.select("row.*"))
