"""Ranked full-text product search.

Query language: web-search style. A query is an OR of branches, a branch an
AND of terms (``a or b -c`` is ``a or (b and not c)``, as in the database's
web-search queries). ``-term`` excludes; ``"a b"`` is a phrase (adjacent words
in that order). Text configuration ``simple``: lower-case runs of letters, their
combining marks and digits of any script, no stemming, no stop words.

Rank (ours; the database's ``ts_rank`` values are not reproduced, only its
"best first" order): occurrences of the query's positive words in the name,
divided by the name's word count; ties by id.

C8 evaluates one query as a filter on the catalogue (one scan, no join).
C9 evaluates a table of queries at once without pairing every query with
every product: product words are exploded into an inverted index, a branch's
candidates are the products that hold the rarest of its positive words, and
its other terms are tested on the candidate's words. A branch made only of
exclusions matches almost all products, so a query with such a branch is
answered by its complement: the products it does *not* match, found the same
way from the excluded words.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import english_tokens, harman_s_stem_py, word_tokens
from .. import session
from .joins import measured

# Shortest accepted query (checked before trimming) and the
# token pattern of the query language.
MIN_QUERY_LENGTH = 2
QUERY_TOKEN_PATTERN = r'-?"[^"]*"|\S+'
WORD_SPLIT = r"[^\p{L}\p{M}\p{N}]+"

SEARCH_COLUMNS = ["id", "name", "available", "brand_name", "brand_id", "stock_count", "price", "description"]


@dataclass(frozen=True)
class Term:
    negated: bool
    words: tuple[str, ...]


def english_stop_words() -> list[str]:
    """Spark ML's English stop-word list (StopWordsRemover default)."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def _english_branches(branches: list[list[Term]], stops: list[str]) -> list[list[Term]]:
    stop = set(stops)
    out = []
    for branch in branches:
        terms = []
        for t in branch:
            words = tuple(harman_s_stem_py(w) for w in t.words if w not in stop)
            if words:
                terms.append(Term(t.negated, words))
        if terms:
            out.append(terms)
    return out


def _words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and the marks that combine with them."""
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()


def parse_query(query: str) -> list[list[Term]]:
    """Branches (ORed) of terms (ANDed) for one query string. An ``or`` without
    a term before or after it is ignored."""
    branches: list[list[Term]] = []
    after_or = False
    for tok in re.findall(QUERY_TOKEN_PATTERN, query):
        if tok.lower() == "or":
            after_or = True
            continue
        neg = tok.startswith("-") and len(tok) > 1
        body = (tok[1:] if neg else tok).strip('"')
        words = tuple(_words(body))
        if not words:
            continue
        if after_or or not branches:
            branches.append([])
        branches[-1].append(Term(neg, words))
        after_or = False
    return branches


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _term_match(tokens: Column, term: Term) -> Column:
    if len(term.words) == 1:
        m = F.array_contains(tokens, F.lit(term.words[0]))
    else:
        m = _padded(tokens).contains(" " + " ".join(term.words) + " ")
    return ~m if term.negated else m


def search_condition(tokens: Column, branches: list[list[Term]]) -> Column:
    cond = F.lit(False)
    for branch in branches:
        every = F.lit(True)
        for term in branch:
            every = every & _term_match(tokens, term)
        cond = cond | every
    return cond


def _equals(word: str):
    # One-argument lambda: PySpark reads a two-argument one as (element, index).
    return lambda x: x == F.lit(word)


def search_rank(tokens: Column, branches: list[list[Term]]) -> Column:
    words = [w for branch in branches for t in branch if not t.negated for w in t.words]
    hits = F.lit(0)
    for w in words:
        hits = hits + F.size(F.filter(tokens, _equals(w)))
    n = F.size(tokens)
    return F.when(n > 0, hits.cast("double") / n)


def product_search(catalog: DataFrame, query: str, config: str = "simple") -> DataFrame:
    """Products whose name matches ``query``, with a rank. The reference
    rejects a query shorter than 2 characters before trimming it.

    ``config``: ``simple`` (lower-case words) or ``english`` (also drops Spark
    ML's English stop words and applies Harman's S-stemmer, on both the names
    and the query words)."""
    if not isinstance(query, str) or len(query) < MIN_QUERY_LENGTH:
        raise ValueError("search query must have at least 2 characters")
    branches = parse_query(query.strip())
    if config == "english":
        stops = english_stop_words()
        branches = _english_branches(branches, stops)
        toks = english_tokens(F.col("name"), stops)
    elif config == "simple":
        toks = word_tokens(F.col("name"))
    else:
        raise ValueError(f"unknown text configuration {config!r}")
    return (catalog.withColumn("_s_tokens", toks)
            .where(search_condition(F.col("_s_tokens"), branches))
            .select(*SEARCH_COLUMNS, search_rank(F.col("_s_tokens"), branches).alias("rank")))


def product_search_sorted(catalog: DataFrame, query: str) -> DataFrame:
    return product_search(catalog, query).orderBy(F.desc("rank"), "id")


# ---- C9: many queries at once ---------------------------------------------------

def parse_queries(queries: DataFrame) -> DataFrame:
    """Terms of every query: (query_id, branch, term, negated, words ARRAY).

    The same rules as ``parse_query``, written with Spark functions; the
    window is per query (a query's own tokens), never across queries.
    """
    toks = queries.select(
        "query_id",
        F.posexplode(F.regexp_extract_all(F.trim(F.col("query")), F.lit(f"({QUERY_TOKEN_PATTERN})"), 1))
        .alias("pos", "tok"))
    is_or = F.lower(F.col("tok")) == "or"
    neg = F.col("tok").startswith("-") & (F.length("tok") > 1)
    body = F.regexp_replace(F.when(neg, F.substr(F.col("tok"), F.lit(2))).otherwise(F.col("tok")), '^"+|"+$', "")
    toks = toks.select("query_id", "pos", is_or.alias("is_or"), neg.alias("negated"),
                       F.filter(F.split(F.lower(body), WORD_SPLIT), lambda w: w != F.lit("")).alias("words"))
    kept = toks.where(F.col("is_or") | (F.size("words") > 0))
    # A term's branch: the number of ``or`` tokens before it (gaps are harmless).
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("branch", F.sum(F.col("is_or").cast("int")).over(w))
    return kept.where(~F.col("is_or")).select("query_id", "branch", F.col("pos").alias("term"), "negated", "words")


class BatchSearch:
    """The answers; ``matches`` and ``complement`` write intermediates and are made when asked for.
    ``rejected``: query_id, query, reason (too short, or without words)."""

    def __init__(self, matches, complement, rejected: DataFrame):
        self._matches, self._complement, self.rejected = matches, complement, rejected

    @cached_property
    def matches(self) -> DataFrame:
        """query_id, id, catalogue columns, rank, position: queries whose branches all hold a positive term"""
        return self._matches()

    @cached_property
    def complement(self) -> DataFrame:
        """query_id, query, complement, excluded_id: the other queries match all products but these"""
        return self._complement()


def _english_terms(terms: DataFrame, stops: list[str]) -> DataFrame:
    """Stop words out and S-stemmer on the parsed query words (same rules as
    ``english_tokens``); terms left without words drop out, and with them
    branches left without terms."""
    from ..functions.text import harman_s_stem

    arr = F.array(*[F.lit(w) for w in stops]) if stops else F.array().cast("array<string>")
    words = F.transform(F.filter("words", lambda w: ~F.array_contains(arr, w)), harman_s_stem)
    return terms.withColumn("words", words).where(F.size("words") > 0)


def product_search_batch(catalog: DataFrame, queries: DataFrame, products: DataFrame | None = None,
                         materialize: bool = True, config: str = "simple", top: int | None = None, index=None) -> BatchSearch:
    """Evaluate ``queries`` (query_id, query) against the catalogue.

    ``products`` (id, name) feeds the inverted index; by default the
    catalogue's own columns. A kept ``index`` (``SearchIndex``, of the ``simple``
    configuration) saves making it: only the buckets of the queries' words are read.
    With ``materialize`` the parsed terms (small: the queries' words) and the postings of
    their words, which several steps read, are checkpointed once.

    As in C8, a query of fewer than 2 characters is rejected; one without words
    matches nothing and is reported beside them. ``position`` counts a query's
    matches from 1, best rank first, ties by id. With ``top`` only the first so many
    are kept, by each task before rows are exchanged, so a query that matches most
    products sends ``top`` rows from each task. In ``complement`` a query
    that excludes no product has one row with a null ``excluded_id``.
    """
    asked = queries.where(F.length("query") >= MIN_QUERY_LENGTH)
    terms = parse_queries(asked)
    if config != "simple" and index is not None:
        raise ValueError("a kept index has words of the simple configuration")
    if config == "english":
        stops = english_stop_words()
        terms = _english_terms(terms, stops)
        tokenize = lambda c: english_tokens(c, stops)
    elif config == "simple":
        tokenize = word_tokens
    else:
        raise ValueError(f"unknown text configuration {config!r}")
    if materialize:
        terms = session.materialize(terms)

    asked_words = terms.select(F.explode("words").alias("word")).distinct()
    if index is not None:
        postings, held = index.postings(asked_words), index.held(asked_words)
    else:
        names = (products if products is not None else catalog).select("id", tokenize(F.col("name")).alias("tokens"))
        postings = names.select("id", "tokens", F.explode(F.array_distinct("tokens")).alias("word")).join(asked_words, "word", "left_semi")
        if materialize:
            postings = session.materialize(postings)
        held = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n_held"))
    # Products per query word; a word that no product holds is rarest of all.
    rarity = F.struct(F.coalesce("n_held", F.lit(0)).alias("n_held"), "word")

    # Every product that holds a query word, once, with each of its names' words. A query then
    # meets a product once and is judged there whole, so no (query, product) rows are made
    # distinct, and the small side, the queries, is the one that is broadcast.
    text = lambda n: F.struct(n.alias("tokens"), _padded(n).alias("text"))
    named = postings.groupBy("id").agg(F.transform(F.collect_set("tokens"), text).alias("names"), F.collect_set("word").alias("words"))
    terms = terms.withColumn("text", _padded(F.col("words")))
    if materialize:
        named = session.materialize(named)
    holding = named.select("id", "names", F.explode("words").alias("word"))

    def fits(name: Column, branch: Column) -> Column:
        return F.forall(branch["terms"], lambda t: F.contains(name["text"], t["text"]) != t["negated"])

    def matched(branches: Column) -> Column:
        """Whether one of the product's names fits one of ``branches``."""
        return F.exists("names", lambda n: F.exists(branches, lambda b: fits(n, b)))

    branches = terms.groupBy("query_id", "branch").agg(
        F.collect_list(F.struct("negated", "words", "text")).alias("terms"),
        F.sum((~F.col("negated")).cast("int")).alias("n_positive"))
    open_branches = branches.where(F.col("n_positive") == 0)
    open_queries = open_branches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("branch", "terms"))).alias("open"))
    positive = terms.where(~F.col("negated"))
    query_words = positive.groupBy("query_id").agg(F.flatten(F.collect_list("words")).alias("rank_words"))
    word_of = positive.select("query_id", "branch", F.explode("words").alias("word"))
    rarest = (word_of.join(held, "word", "left").groupBy("query_id", "branch")
              .agg(F.min(rarity).alias("r")).select("query_id", "branch", F.col("r.word").alias("word")))
    anchored = rarest.join(branches, ["query_id", "branch"])
    of_query = anchored.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("branch", "terms"))).alias("all"))
    wanted = (anchored.join(of_query, "query_id").join(query_words, "query_id").join(open_queries, "query_id", "left_anti")
              .select("query_id", "word", F.filter("all", lambda b: b["branch"] < F.col("branch")).alias("earlier"),
                      F.filter("all", lambda b: b["branch"] == F.col("branch")).alias("own"), "all", "rank_words"))
    # The product counts at the first branch that it fits.
    found = holding.join(measured(wanted), "word").where(matched(F.col("own")) & ~matched(F.col("earlier")))
    occurrences = lambda n: F.aggregate("rank_words", F.lit(0), lambda k, w: k + F.size(F.filter(n, lambda x: x == w)))
    ranks = F.transform(F.filter("names", lambda n: F.exists("all", lambda b: fits(n, b))), lambda n: occurrences(n["tokens"]).cast("double") / F.size(n["tokens"]))
    found = found.select("query_id", "id", F.explode(F.array_distinct(ranks)).alias("rank"))

    def matches() -> DataFrame:
        placed = found.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank").desc(), "id")))
        placed = placed if top is None else placed.where(F.col("position") <= top)
        return placed.join(catalog.select(*SEARCH_COLUMNS), "id").select("query_id", *SEARCH_COLUMNS, "rank", "position")

    def complement() -> DataFrame:
        # Products that every exclusion-only branch shuts out and no other branch matches: looked
        # for by the words of the query's first such branch, and counted at its first term that shuts.
        first_open = open_queries.select("query_id", F.col("open")[0].alias("shutting"), "open")
        shut_terms = first_open.select("query_id", "open", F.array_distinct("shutting.terms").alias("terms")).select(
            "query_id", "open", "terms", F.posexplode("terms").alias("place", "term"))
        shut_words = shut_terms.select("query_id", "place", F.explode("term.words").alias("word"))
        anchors = (shut_words.join(held, "word", "left").groupBy("query_id", "place")
                   .agg(F.min(rarity).alias("r")).select("query_id", "place", F.col("r.word").alias("word")))
        shut = (shut_terms.join(anchors, ["query_id", "place"]).join(of_query, "query_id", "left")
                .select("query_id", "word", "open", F.slice("terms", F.lit(1), F.col("place")).alias("earlier"), F.col("term").alias("own"),
                        F.coalesce("all", F.array().cast(of_query.schema["all"].dataType)).alias("all")))
        held_by = lambda term: F.exists("names", lambda n: F.contains(n["text"], term["text"]))
        shut_out = F.forall("open", lambda b: F.exists(b["terms"], lambda t: held_by(t)))
        excluded = (holding.join(measured(shut), "word")
                    .where(held_by(F.col("own")) & ~F.exists("earlier", lambda t: held_by(t)) & shut_out & ~matched(F.col("all")))
                    .select("query_id", F.col("id").alias("excluded_id")))
        if materialize:
            excluded = session.materialize(excluded)
        open_asked = measured(asked.join(open_queries, "query_id", "left_semi").select("query_id", "query"))
        none = open_asked.join(excluded.select("query_id").distinct(), "query_id", "left_anti").withColumn("excluded_id", F.lit(None).cast(excluded.schema["excluded_id"].dataType))
        return (excluded.join(open_asked, "query_id").unionByName(none)
                      .select("query_id", "query", F.lit(True).alias("complement"), "excluded_id"))

    short = F.coalesce(F.length("query") < MIN_QUERY_LENGTH, F.lit(True))
    rejected = (queries.join(branches.select("query_id"), "query_id", "left_anti")
                .select("query_id", "query", F.when(short, "too_short").otherwise("no_words").alias("reason")))
    return BatchSearch(matches, complement, rejected)
