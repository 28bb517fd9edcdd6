"""URL filters, sharding and fingerprints against plain Python; no Python in their plans."""

import collections
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from marketlane.llm import fingerprints, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def brute_judge(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(r.key), r.host, r.verdict, r.key) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in blocked) else "allow"


def test_url_filter(session):
    urls = ["http://a.example.org/en/12?x", "https://EXAMPLE.org/es/", "example.org/es/", None, "", "http://x.org", "http://x.org/", "http://com/de/1", "ftp://a.b.c.com/fr/x#y",
            "http://notexample.org/es/", "http://spam.example.net:80/", "http://a.bad.example.net/q", "http://bad.example.net?x", "http:///de/", "x://y://z/fr/", "http://" + "a." * 3000 + "com/de/" + "z" * 9000]
    pages = session.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, *urls])] + [(None, None, None, None)], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, queries.URL_RULES, ["bad.example.net"])
    rows = got.collect()
    assert len(rows) == pages.count()
    for r in rows:
        url = None if r.page_id is None else urls[r.page_id % len(urls)]
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(url, queries.URL_RULES, ["bad.example.net"]), url
    no_python(url_filter.judge_urls(session.read.parquet(f"{SF}/pages.parquet"), queries.URL_RULES, []))
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES, []).count() == 0


def test_cascade_is_exact_for_the_corpus(session):
    universe = session.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).cache()
    listed = universe.where("crc32(key) % 11 = 0")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    got = universe.where(cascade.contains(F.col("key")))
    assert got.count() == listed.count() and got.join(listed, "key", "left_anti").count() == 0
    assert universe.where(url_filter.build_cascade(listed.limit(0), universe).contains(F.col("key"))).count() == 0


def test_url_lists_too_long_for_a_cascade(session, monkeypatch):
    """The same answers by a join, from a table of hosts."""
    pages = session.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(session.createDataFrame([(-1, None), (-2, "x"), (-3, "http://a.bad.example.net/es/"), (-3, "http://a.bad.example.net/es/"), (None, "http://bad.example.net")], pages.schema))
    hosts = session.createDataFrame([("bad.example.net",), ("example.com",), (None,), ("",), ("example.com",)], "blocked string")
    want = sorted(map(str, url_filter.judge_urls(pages, queries.URL_RULES, ["bad.example.net", "example.com"]).collect()))
    assert sorted(map(str, url_filter.judge_urls(pages, queries.URL_RULES, hosts).collect())) == want
    monkeypatch.setattr(url_filter, "MAX_CASCADE_BITS", 1)
    joined = url_filter.judge_urls(pages, queries.URL_RULES, hosts)
    no_python(joined)
    assert sorted(map(str, joined.collect())) == want and any("block" in w for w in want)


def test_url_query(session):
    urls = {r.page_id: r.url for r in session.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.queries()["op3_url_filters"](session, SF).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[r.page_id], queries.URL_RULES, queries.BLOCKED_HOSTS)


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009
    for bad in ((shards, 1000), ([], 1009), (["a", "a"], 1009)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_lookup_table_by_full_preference_lists():
    """A second fill: every shard's whole preference list is written out first."""
    shards, size = [f"s{i}" for i in range(5)], 211
    lists = []
    for name in shards:
        offset, skip = (int(hashlib.sha256(f"{what}:{name}".encode()).hexdigest()[:16], 16) for what in ("offset", "skip"))
        lists.append([(offset % size + j * (skip % (size - 1) + 1)) % size for j in range(size)])
        assert sorted(lists[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(lists):
            if len(owner) < size:
                owner[next(slot for slot in order if slot not in owner)] = i
    assert sharding.lookup_table(shards, size) == [owner[slot] for slot in range(size)]


def test_sharding(session, edge_docs, no_docs, tmp_path):
    table = sharding.lookup_table(queries.SHARDS)
    slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    placed = sharding.place(edge_docs, "doc_id", queries.SHARDS)
    assert all((r.slot, r.shard) == (slot(r.doc_id), queries.SHARDS[table[slot(r.doc_id)]]) for r in placed.collect())
    no_python(queries.queries()["op9_sharding"](session, SF))
    assert sharding.place(no_docs, "doc_id", queries.SHARDS).count() == 0
    sharding.write_shards(edge_docs, str(tmp_path / "s"), "doc_id", ["a", "b"], files_per_shard=2)
    assert session.read.parquet(str(tmp_path / "s")).count() == edge_docs.count()


def brute_sketch(text):
    words = re.findall(fingerprints.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    one = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed)
    h = [one(w.encode(), 42) for w in words]

    def chain(values, seed=42):
        for v in values:
            seed = one(v.to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    if len(h) >= 5:
        all_ = [signed(chain(h[i:i + 5])) for i in range(len(h) - 4)]
    else:
        value = 0
        for x in h:
            value = chain([value % 2**64, x])
        all_ = [signed(value)] if h else []
    kept = sorted({x for x in all_ if x < -(1 << 63) + (1 << 64) // fingerprints.SCALE})
    return kept or ([min(all_)] if all_ else [])


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return len(set(a) & set(b)) / min(len(a), len(b))


def test_fingerprints(session):
    docs = session.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    query = queries.queries()["op10_fingerprints"](session, SF)
    no_python(query)
    got = sorted(query.collect(), key=lambda r: -r.doc_id)
    assert [r.doc_id for r in got] == sorted(texts, reverse=True)
    for r, after in zip(got, got[1:] + got[:1]):
        text, following = texts[r.doc_id], texts[after.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other, theirs = brute_sketch(text), brute_sketch(edited), brute_sketch(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x % 2**64:016X}" for x in own) and r.edited_fingerprint == "".join(f"{x % 2**64:016X}" for x in other)
        assert r.near_edited == pytest.approx(brute_likeness(own, other)) and r.near_next == pytest.approx(brute_likeness(own, theirs))


def test_fingerprint_edges(session, edge_docs, no_docs):
    paired = fingerprints.with_next(edge_docs).collect()
    assert len(paired) == edge_docs.count()
    for r in paired:
        assert r.sketch == brute_sketch(r.text) and r.next_sketch == brute_sketch(r.next_text)
    assert fingerprints.with_next(no_docs).count() == 0
    alone = fingerprints.with_next(edge_docs.where("doc_id = 0")).first()
    assert alone.next_text == alone.text
