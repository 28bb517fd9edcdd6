"""URL filter lists as Bloom filter cascades.

A list of keys (host, or host and path prefix) is encoded for the corpus at
hand: level 0 is a Bloom filter of the listed keys, level 1 one of the corpus
keys that level 0 passes wrongly, level 2 one of the listed keys that level 1
passes, and so on until a level passes nothing wrongly. For every key of the
corpus the cascade then answers exactly, with a few bits per listed key and no
join. Everything is DataFrame functions; only the finished filters, whose size
follows the list and not the corpus, come to the driver and go into the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .staging import pick, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_CASCADE_BITS = 1 << 27     # 16 MB in the plan; a longer list is looked up by a join, with the same answers


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the URLs of ``host`` and its subdomains whose path starts with ``path``."""
    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words are an array literal in the plan."""
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for at in self.positions(key):
            hit = hit & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return hit

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits).cast("long")) for j in range(self.hashes)]


def _level(keys: DataFrame, number: int, n: int, wrong: float) -> Level:
    """A Bloom filter of the ``n`` values of ``keys.key`` that passes other keys with probability ``wrong``."""
    hashes = max(1, round(-math.log2(wrong)))
    bits = max(64, 64 * math.ceil(n * -math.log2(wrong) / math.log(2) / 64))
    empty = Level(number, bits, hashes, ())
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    filled = {int(r["word"]): int(r["bits"]) for r in words.collect()}     # bits / 64 rows: bounded by the list
    return Level(number, bits, hashes, tuple(filled.get(i, 0) for i in range(bits // 64)))


class Cascade:
    """Exact membership of a list, for the keys of one corpus."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, keys: Column) -> Column:
        """Those of ``keys``, an array of keys of the corpus, that are listed."""
        return F.filter(keys, self.contains)

    def contains(self, key: Column) -> Column:
        """Whether ``key``, a key of the corpus the cascade was built for, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer

    @property
    def bits(self) -> int:
        return sum(level.bits for level in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of ``listed.key`` over ``universe.key`` (repeated and null keys
    count once, or not at all). An empty list gives a cascade of no levels, one that
    would need more than ``MAX_CASCADE_BITS`` none at all."""
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    size = universe.agg(F.approx_count_distinct("key")).first()[0] or 0
    wrong = min(0.5, max(2.0 ** -30, math.sqrt(0.5) * n / max(1, size)))
    if n * -math.log2(wrong) / math.log(2) > MAX_CASCADE_BITS:
        return None
    levels = [_level(listed, 0, n, wrong)]
    passed = universe.where(F.col("key").isNotNull() & levels[0].passes(F.col("key"))).select("key").distinct()
    others = stage(passed.join(listed, "key", "left_anti"), "cascade-others")
    sides = {1: others, 0: listed}     # by parity of the next level: the keys it has to encode
    n = others.count()
    while n:
        number = len(levels)
        levels.append(_level(sides[number % 2], number, n, 0.5))
        # What this level passes wrongly of the other side is left for the next one.
        parity = (number + 1) % 2
        sides[parity] = stage(sides[parity].where(levels[-1].passes(F.col("key"))), "cascade-left")
        n = sides[parity].count()
    return Cascade(levels)


def key_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A list given in the program, as a table ``key``."""
    return spark.range(1).select(F.explode(F.split(F.lit("\n".join(keys)), "\n")).alias("key")).where("key != ''")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end; no ``://`` or null: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    pattern = r"(?s)^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER), F.regexp_extract(rest, pattern, 2)


def candidate_keys(host: Column, path: Column, shapes: set[tuple[int, int]]) -> Column:
    """All keys of a URL that a list of these (labels, path length) shapes can hold."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*[
        F.when((labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in sorted(shapes)])) if shapes else F.array().cast("array<string>")


def list_shapes(keys: DataFrame) -> set[tuple[int, int]]:
    """The (labels, path length) shapes of the keys of a list: one row for each."""
    host = F.regexp_extract("key", r"^[^/]*", 0)
    shape = keys.select((F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).alias("labels"), (F.length("key") - F.length(host)).alias("path"))
    return {(r["labels"], r["path"]) for r in shape.distinct().toLocalIterator()}


def joined_keys(parts: DataFrame, candidates: Column, listed: DataFrame, name: str) -> DataFrame:
    """``parts`` with the listed ones of each row's ``candidates`` as ``name``: for lists
    too long for a cascade. The keys of the corpus are looked up once each; ``parts`` is
    numbered by ``row``."""
    asked = parts.select("row", F.explode(candidates).alias("key"))
    known = stage(asked.select("key").distinct().join(listed.select("key").distinct(), "key", "left_semi"), "url-listed")
    found = asked.join(known, "key").groupBy("row").agg(F.collect_list("key").alias(name))
    return parts.join(found, "row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def judge_urls(pages: DataFrame, rules: list[Rule], blocked_hosts: list[str] | DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    The longest rule (by key, then host; ``block`` before ``allow`` if both are
    given for one key) that fits decides. Without one, a URL is blocked if its
    host or a parent domain of it is in ``blocked_hosts`` (a list, or a table of one
    column, of any length), else allowed. Both are looked up in cascades over all keys
    of ``pages``; a list too long for one by a join. A null or malformed URL has
    empty host and path, fits no rule and is allowed.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pick(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    # A blocked host is a key without a path.
    hosts = blocked_hosts if isinstance(blocked_hosts, DataFrame) else key_table(spark, blocked_hosts)
    hosts = hosts.select(F.col(hosts.columns[0]).cast("string").alias("key")).where("key != ''")
    lists = {verdict: key_table(spark, [r.key for r in rules if r.verdict == verdict]) for verdict in ("allow", "block")}
    lists["block"] = lists["block"].unionByName(hosts)
    candidates = {name: candidate_keys(F.col("host"), F.col("path"), list_shapes(listed)) for name, listed in lists.items()}
    cascades = {}
    for name, listed in lists.items():
        cascades[name] = build_cascade(listed, stage(parts.select(F.explode(candidates[name]).alias("key")).distinct(), "url-keys"))
    found = parts
    if None in cascades.values():
        found = stage(parts.withColumn("row", F.monotonically_increasing_id()), "url-parts")
    for name, cascade in cascades.items():
        found = found.withColumn(name, cascade.listed(candidates[name])) if cascade else joined_keys(found, candidates[name], lists[name], name)

    def fitting(name: str, rank: int) -> Column:
        return F.transform(F.filter(F.col(name), lambda k: F.instr(k, "/") > 0), lambda k: F.struct(
            F.length(k).alias("size"), F.instr(k, "/").alias("host_size"), F.lit(rank).alias("rank"), k.alias("key"), F.lit(name).alias("verdict")))

    best = F.array_max(F.concat(fitting("allow", 0), fitting("block", 1)))
    listed_host = F.exists("block", lambda k: F.instr(k, "/") == 0)
    judged = found.withColumn("best", best).withColumn("listed", listed_host)
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"),
                         F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
