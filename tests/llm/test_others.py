"""HTML, sharding, URL filters, WARC, packing."""

import html
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, packing, sharding, url_filter, warc
from millrace.llm import html_extract as H
from millrace.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.train(labelled_pages())


def brute_marginals(tree, model):
    """By summing over all assignments of states."""
    n = len(tree.parent)
    score = np.array([sum(model.weights[f] for f in fs) + model.bias for fs in tree.features])
    log = np.stack([-np.logaddexp(0, score), -np.logaddexp(0, -score)], 1)
    total, ones = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> k) & 1 for k in range(n)]
        p = np.exp(model.first[y[0]] + sum(log[k, y[k]] for k in range(n)) + sum(model.edge[y[tree.parent[k]], y[k]] for k in range(1, n)))
        total += p
        ones += p * np.array(y)
    return ones / total


def test_marginals_are_exact(model):
    pages = ["<div class=ad>x y.<p>one two, three.</div><p>Hello there, this is text.", "plain", "<ul><li>a<li>b</ul><b>c"]
    trees = [H.parse(p) for p in pages]
    got, at = H.marginals(trees, model), 0
    for t in trees:
        assert got[at : at + len(t.parent)] == pytest.approx(brute_marginals(t, model), abs=1e-9)
        at += len(t.parent)


def test_held_out_pages(model):
    right = total = 0
    trees = [H.parse(p) for p in labelled_pages(150, seed=5)]
    p, at = H.marginals(trees, model), 0
    for t in trees:
        for node, _, text in t.texts:
            right += len(text) * ((p[at + node] > 0.5) == bool(t.labels[node]))
            total += len(text)
        at += len(t.parent)
    assert right / total > 0.98


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in H.op2(spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[r.page_id], re.S)[1]
        want = Counter(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        got = Counter(r.text.split())
        assert sum((want - got).values()) <= 0.02 * sum(want.values()) and sum((got - want).values()) <= 0.1 * sum(want.values()) + 10
        assert "track(" not in r.text


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</x>" * 100_000, "<p><body>" + "<b>" * 30_000 + "<h1>" * 30_000, "<ul><li>" * 30_000 + "<td>" * 30_000])
def test_parsing_is_linear(page):
    began = time.perf_counter()
    assert len(H.parse(page).parent) > 30_000
    assert time.perf_counter() - began < 20


def test_what_closes_what():
    tags = lambda page: [(t, H.parse(page).depth[n]) for n, _, t in H.parse(page).texts]
    assert tags("<p>a<b>b<p>c") == [("a", 2), ("b", 3), ("c", 2)]
    assert tags("<ul><li>a<ul><li>b</ul>c<li>d</ul>e") == [("a", 3), ("b", 5), ("c", 3), ("d", 3), ("e", 1)]
    assert tags("<table><tr><td>a<table><tr><td>b</table><td>c<tr><td>d") == [("a", 4), ("b", 7), ("c", 4), ("d", 4)]
    assert tags("<p>a<table><td><p>b</td></table>c") == [("a", 2), ("b", 4), ("c", 1)]
    long = "x" * 32
    assert H.parse(f"<i class={long}a>t").features[1] != H.parse(f"<i class={long}b>t").features[1]


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "deep text, here." + "</div>" * 10
    odd = [None, "", "<", "<p", "a<b", "</p></div>x", "<!-- never ends", "<script>var x='<p>';", "<p>" + "Long text, really. " * 50_000, deep, "<a href='x>y'>q</a>", "&amp;&#x41;&bogus;", "<DIV CLASS=AD>Z</DIV>"]
    df = spark.createDataFrame(list(enumerate(odd)) + [(None, "x"), (1, "")], "page_id long, html string").withColumn("text", F.lit(1))
    rows = H.extract_content(df, model).collect()
    assert len(rows) == len(odd) + 2
    by = {r.page_id: r for r in rows}
    assert by[0].text == "" and by[0].nodes == 1 and by[7].text == "" and len(by[8].text) > 900_000
    assert H.extract_content(df.limit(0), model).count() == 0
    tree = H.parse("<p>one<p>two<ul><li>a<li>b</ul>")
    assert [tree.parent[n] for n, _, _ in tree.texts] == sorted({tree.parent[n] for n, _, _ in tree.texts})
    assert H.train([]).bias > 0


def brute_table(shards, slots):
    import hashlib

    names, order = sorted(shards), {}
    for s in names:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order[s] = [(offset + j * skip) % slots for j in range(slots)]
    table = {}
    while len(table) < slots:
        for s in names:
            if len(table) < slots:
                table[next(x for x in order[s] if x not in table)] = s
    return [table[k] for k in range(slots)]


def test_sharding(spark, sf):
    shards = ["c", "a", "b", "e", "d"]
    table = sharding.fill_table(shards, 101)
    assert [shards[k] for k in table] == brute_table(shards, 101)
    full = sharding.fill_table(sharding.SHARDS)
    sizes = np.bincount(full)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    assert (full != fewer).mean() < 0.05
    for bad in ((["a"], 100), ([], 101), (["a", "a"], 101), ([str(k) for k in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    import hashlib

    rows = sharding.op3(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == slot and r.shard == sharding.SHARDS[full[slot]]
    odd = spark.createDataFrame([(None, 1, "x"), ("", 2, "y"), ("a", 3, "z"), ("a", 3, "z")], "k string, slot int, _ string")
    got = sharding.place(odd, "k").collect()
    assert len(got) == 4 and len({r.shard for r in got if not r.k}) == 1 and len({r.shard for r in got if r.k}) == 1
    assert sharding.place(odd.limit(0), "k").count() == 0
    assert {"text", "lang"} < set(rows[0].asDict()) and {r.doc_id: r.text for r in rows} == {r.doc_id: r.text for r in docs.collect()}
    long = spark.createDataFrame([("k" * 200_000 + x,) for x in "ab"], "k string")
    assert [r.slot for r in sharding.place(long, "k").collect()] == [int(hashlib.md5(("k" * 200_000 + x).encode()).hexdigest()[:15], 16) % sharding.SLOTS for x in "ab"]


def test_url_filter(spark):
    entry = lambda kind, pattern, action, event, day, name="l": (name, kind, pattern, action, event, f"2024-01-{day:02d} 00:00:00")
    entries = spark.createDataFrame([
        entry("host", "bad.com", "block", "add", 5), entry("host", "bad.com", "block", "remove", 10), entry("host", "bad.com", "block", "add", 20),
        entry("prefix", "bad.com/ok/", "allow", "add", 1), entry("url", "bad.com/ok/x?a=1", "block", "add", 1), entry("host", "sub.bad.com", "allow", "add", 1),
        entry("host", "tie.com", "block", "add", 1, "a"), entry("host", "tie.com", "allow", "add", 1, "b"), entry("host", "", "block", "add", 1), entry("odd", "x", "block", "add", 1),
        entry("host", "same.com", "block", "add", 3), entry("host", "same.com", "block", "remove", 3), entry("host", "bad.com", "block", "add", 5),
    ], "list_name string, kind string, pattern string, action string, event string, at string").withColumn("extra", F.lit(1))
    cases = [("http://bad.com/", 4, "allow"), ("http://bad.com/", 5, "block"), ("http://bad.com/", 10, "allow"), ("https://U:p@BAD.com:80/x#y", 25, "block"), ("http://bad.com/ok/y", 25, "allow"), ("http://bad.com/ok/x?a=1", 25, "block"), ("http://sub.bad.com/q", 25, "allow"), ("http://deep.other.bad.com/q", 25, "block"), ("http://notbad.com/", 25, "allow"), ("http://tie.com/", 2, "allow"), ("http://same.com/", 3, "allow"), (None, 5, "block"), ("", 5, "allow"), ("x" * 5000, 5, "allow")]
    entries = entries.union(spark.createDataFrame([
        (*entry("prefix", "http://Pre.com:80/a?x=", "block", "add", 1), 1), (*entry("prefix", "pre.com/en", "block", "add", 1), 1), (*entry("prefix", "whole.com", "block", "add", 1), 1),
        (*entry("host", "https://u@port.com:8080/q", "block", "add", 1), 1), (*entry("prefix", "long.com/" + "a" * 3000, "block", "add", 1), 1), (*entry("url", "long.com/" + "a" * 3000 + "b", "allow", "add", 1), 1),
    ], entries.schema))
    cases += [("http://pre.com/a?x=1", 5, "block"), ("http://pre.com/a?y=1", 5, "allow"), ("http://pre.com/english/x", 5, "block"), ("http://pre.com/e", 5, "allow"), ("http://whole.com", 5, "block"), ("http://whole.com?q", 5, "block"), ("http://whole.company.com/", 5, "allow"), ("http://port.com/", 5, "block"), ("http://long.com/" + "a" * 3001, 5, "block"), ("http://long.com/" + "a" * 3000 + "b", 5, "allow")]
    captures = spark.createDataFrame([(k, u, f"2024-01-{d:02d} 00:00:00") for k, (u, d, _) in enumerate(cases)] * 2 + [(99, "http://bad.com/", None)], "page_id long, url string, fetched string").withColumn("kind", F.lit("x")).withColumn("verdict", F.lit(0))
    got = {r.page_id: r for r in url_filter.filter_urls(captures, entries).collect()}
    assert {k: r.verdict for k, r in got.items()} == {**{k: v for k, (_, _, v) in enumerate(cases)}, 99: "allow"}
    assert got[1].active == 1 and got[9].active == 2 and got[9].list_name == "b"
    assert url_filter.filter_urls(captures, entries).count() == len(cases) + 1
    assert {r.verdict for r in url_filter.filter_urls(captures.where("url is not null"), entries.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0


def test_warc(spark):
    kind = "record_id string, kind string, url string, fetched string, status int, headers string, payload_digest string, payload_length long"
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [
        ("r1", "response", "http://www.A.com/x/", at(1), 200, 'ETag: "1"\r\nServer: s\r\nDate: d1\r\nbroken', "p1", 10),
        ("r2", "response", "https://a.com/x", at(5), 200, 'ETag: "2"', "p2", 20),
        ("r3", "response", "https://a.com/x", at(5), 404, "", "p3", 30),
        ("r4", "response", "http://b.com/", at(1), 200, "Last-Modified: m", "p4", 40),
        ("r5", "response", "http://b.com/", at(1), 200, "Last-Modified: n", "p5", 50),
        ("r6", "response", None, at(1), 200, "", "p", 1),
        ("v1", "revisit", "https://a.com:443/x?utm_source=q#f", at(3), 304, 'etag: W/"1"\r\nDate: d2\r\nContent-Length: 0\r\nX: y', None, None),
        ("v2", "revisit", "http://a.com/x", at(5), 304, 'etag: "1"', None, None),
        ("v3", "revisit", "http://a.com/x", at(6), 304, 'etag: "1"', None, None),
        ("v4", "revisit", "http://a.com/x", at(1), 304, 'etag: "1"', None, None),
        ("v5", "revisit", "http://b.com", at(2), 304, "Last-Modified: n", None, None),
        ("v6", "revisit", "http://b.com", at(2), 304, None, None, None),
        ("v7", "revisit", None, at(2), 304, "etag: x", None, None),
        ("v8", "revisit", "http://b.com", None, 304, "etag: x", None, None),
        ("v5", "revisit", "http://b.com", at(2), 304, "Last-Modified: n", None, None),
    ]
    df = spark.createDataFrame(rows, kind).withColumn("canonical", F.lit(1)).withColumn("full", F.lit(2))
    got = warc.resolve_revisits(df).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 9
    assert {k: (r.outcome, r.refers_to) for k, r in by.items()} == {"v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("validator_mismatch", "r2"), "v4": ("no_earlier_response", None), "v5": ("resolved", "r5"), "v6": ("no_validator", "r5"), "v7": ("no_earlier_response", None), "v8": ("no_earlier_response", None)}
    assert by["v1"].headers == 'date: d2\netag: W/"1"\nserver: s' and by["v1"].payload_digest == "p1" and by["v3"].payload_length == 0
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    url, tag = "http://long.com/" + "a" * 50_000, 'ETag: "' + "e" * 50_000 + '"'
    long = spark.createDataFrame([("r", "response", url, at(1), 200, tag + "\r\nX: " + "y" * 100_000, "p", 1), ("v", "revisit", url + "#f", at(2), 304, tag, None, None), ("w", "revisit", url + "b", at(2), 304, tag, None, None)], kind)
    got = {r.record_id: r for r in warc.resolve_revisits(long).collect()}
    assert got["v"].outcome == "resolved" and len(got["v"].headers) > 150_000 and got["w"].outcome == "no_earlier_response"


def brute_pack(lengths, capacity):
    gaps, out = [], []
    touched = []
    for t, s in enumerate(lengths):
        def cost(k):
            after = list(gaps)
            if k is None:
                after.append(capacity - s)
            else:
                after[k] -= s
            return sum(c * c for g, c in Counter(after).items() if 0 < g < capacity)

        options = [(cost(k), gaps[k] - s, 0, touched[k], k) for k in range(len(gaps)) if gaps[k] >= s and gaps[k] > 0] + [(cost(None), capacity - s, 1, 0, None)]
        best = min(options, key=lambda x: x[:4])[4]
        if best is None:
            gaps.append(capacity)
            touched.append(0)
            best = len(gaps) - 1
        gaps[best] -= s
        touched[best] = t
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_against_brute_force(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(3, 30))
    lengths = r.integers(1, capacity + 1, 150)
    assert packing.pack_group(lengths, capacity).tolist() == brute_pack(lengths.tolist(), capacity)


def test_packing(spark, sf):
    rows = packing.op7(spark, sf).collect()
    docs = {r.doc_id: r.n_ids + 1 for r in bpe.op8(spark, sf).collect()}
    placed, bins = Counter(), Counter()
    for r in rows:
        placed[r.doc_id] += r.length
        bins[r.bin_group, r.bin_id] += r.length
        assert r.start == r.piece * packing.CAPACITY
    assert placed == Counter(docs) and max(bins.values()) <= packing.CAPACITY
    assert all(packing.CAPACITY - bins[r.bin_group, r.bin_id] == r.gap for r in rows)
    assert len(bins) <= 1.15 * sum(docs.values()) / packing.CAPACITY + 2
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (None, None), (2, None), (3, ""), (4, "w " * 50)], "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("bin_group", F.lit(1))
    got = packing.pack(odd, capacity=10, group=3).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2 + 1 + 1 + 1 + 51 and max(Counter((r.bin_group, r.bin_id) for r in got).values()) <= 10
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    got = packing.pack(rows, capacity=10, group=256).collect()
    assert len(got) == 3000 and Counter(r.doc_id for r in got)[7] == 1000
    sizes = Counter(r.bin_group for r in got)
    assert len(sizes) == 16 and max(sizes.values()) < 4 * 256
    # a document more changes one group, as long as the number of groups stays
    more = {tuple(r) for r in packing.pack(rows.union(spark.createDataFrame([(99_999, "c")], rows.schema)), capacity=10, group=256).collect()}
    assert len({g for g, *_ in more ^ {tuple(r) for r in got}}) == 1
