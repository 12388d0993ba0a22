import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from simweave.llm import pathtree, qgram, warc
from simweave.llm.queries import URL_RULES
from tests.llm.brute import LOWER

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    long = "é\r\n\r\n<p>" * 50000
    rows = [(1, "http://a.org/x", "one"), (2, "http://a.org/y", "one"), (3, None, "one"), (4, "http://a.org/z\r\nX: y", None), (5, "u", ""), (6, "http://a.org/x", long), (7, "http://a.org/x", "tail\r\n\r\n"), (None, "http://n", "one"), (8, "http://b", "two"), (8, "http://b", "two")]
    df = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit(1)).withColumn("last", F.lit(2)).withColumn("type", F.lit(3))
    got = {}
    for r in warc.round_trip(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        for r in got[i]:
            assert r["payload_bytes"] == len(data)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kind = {i: [(r["record_type"], r["refers_to"]) for r in rs] for i, rs in got.items()}
    assert kind == {1: [("revisit", 3)], 2: [("revisit", 3)], 3: [("response", None)], 4: [("revisit", 5)], 5: [("response", None)], 6: [("response", None)], 7: [("response", None)], None: [("response", None)], 8: [("response", None)] * 2}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_blocks_that_equal_pages_span(spark, tmp_path):
    rows = [(i // 20, f"http://a.org/{i // 20}", f"text {i}") for i in range(100)] + [(None, "http://a.org/2", "x")] * 15
    df = spark.createDataFrame(rows, PAGES)
    archive = warc.write(df, f"file://{tmp_path}/arc", lines=7)
    assert sorted(r["page_id"] if r["page_id"] is not None else -1 for r in archive.fetch(df).collect()) == sorted(-1 if i is None else i for i, _, _ in rows)


def test_archives_are_read_in_several_tasks(spark, tmp_path):
    df = spark.range(400).selectExpr("id as page_id", "concat('http://a.org/', id) as url", "repeat(cast(id as string), 50) as html").repartition(8)
    archive = warc.write(df, f"file://{tmp_path}/arc")
    got = archive.fetch(df)
    assert archive.archives >= 4 and got.rdd.getNumPartitions() == archive.archives and got.count() == 400


def test_lookup(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 9}.example.org/p{i % 30}?q=1", f"text {i % 40}") for i in range(300)]
    archive = warc.write(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/arc", lines=7)
    assert archive.directory.count() > 20
    for url in ("http://h3.example.org/p12?q=1", "http://H3.example.org/p12?q=1", "http://none/"):
        found = archive.lookup([url])
        assert [x["page_id"] for x in found] == [i for i, u, _ in rows if u == url]
        for x in found:
            assert x["headers"]["warc-type"] == x["type"]
            if x["type"] == "response":
                assert x["payload"].decode() == rows[x["page_id"]][2]
    wanted = spark.createDataFrame([(u, i) for i, u, _ in rows[:50]] + [(rows[0][1], 0)] * 3 + [("http://none/", 1), (rows[0][1], 7), (None, None)], "url string, page_id long")
    for most in (1_000_000, 10):
        monkeypatch.setattr(warc, "DIRECTORY_ROWS", most)
        assert sorted(r["page_id"] for r in archive.fetch(wanted).collect()) == list(range(50))
    assert sorted(r["page_id"] for r in archive.read().collect()) == list(range(300))
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", 1)
    assert len(archive.lookup(["http://h3.example.org/p12?q=1"])) == sum(u == "http://h3.example.org/p12?q=1" for _, u, _ in rows)


@pytest.mark.parametrize(("url", "key"), [("http://Blog.Example.com:80/a?b#c", "com,example,blog)/a?b"), ("https://x.org", "org,x)/"), ("https://x.org#f", "org,x)/"), ("plain", "plain"), (None, ""), ("http://u@h.de/", "de,h)/")])
def test_keys(url, key):
    assert warc.capture_key(url) == key


URLS = [
    (1, "http://a.example.org/x", "a.example.org", "/x", "org/", "allow"),
    (2, "http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    (3, "http://m.example.org/en/17", "m.example.org", "/en/17", "example.org/en/1", "block"),
    (4, "http://x.com/fr/a?b", "x.com", "/fr/a", "com/fr/", "allow"),
    (5, "ftp://com/de/#x", "com", "/de/", "com/de/", "block"),
    (6, "http://notexample.org?x", "notexample.org", "", None, "allow"),
    (7, "xorg/es/", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "http://É.ORG/a#b?c", "É.org", "/a", "org/", "allow"),
    (10, "http://a.net/://b/c", "a.net", "/://b/c", None, "allow"),
    (None, "http://a.net", "a.net", "", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("segs", F.lit(2)).withColumn("rule", F.lit(3))
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in pathtree.judge(df, spark.createDataFrame([], "page_id long, good int"), URL_RULES).collect()}
    assert got == {u[0]: u[2:] for u in URLS}
    assert pathtree.judge(df.limit(0), spark.createDataFrame([], "page_id long, good int"), URL_RULES).count() == 0


def test_tree(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        kind = i % 3
        name = "".join(rng.choice("abcdefgh") for _ in range(9))
        rows.append((i, f"http://s.net/{['news', 'spam', 'blog'][kind]}/{name}" + ("/12.html" if i % 2 else "")))
        if i % 4 < 2:
            labels.append((i, int(kind != 1)))
    labels += [(0, None), (None, 0), (3, 1), (3, 1)]
    got = pathtree.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), []).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 1) for r in got)
    assert {r["template"] for r in got if r["page_id"] % 3 == 1} == {"/spam/*", "/spam/*/<n>.html"}


def test_a_hot_branch_among_singletons_stays_apart(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:06d}")
    for many in (1500, 900):
        rows = [(i, f"http://s.net/{name(i)}") for i in range(1000)] + [(1000 + i, f"http://s.net/spam/{name(i)}") for i in range(many)]
        labels = [(i, int(i < 1000)) for i, _ in rows]
        got = pathtree.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), []).collect()
        assert {(r["page_id"] >= 1000, r["template"], r["verdict"]) for r in got} == {(False, "/*", "allow"), (True, "/spam/*", "block")}


def test_branches_below_six_segments_are_told_apart(spark):
    rows = [(i, f"http://s.net/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/x/y/{'tail' if i < 90 else i}") for i in range(100)] + [(100, "http://s.net/a/q/r/s/t/u/v/w"), (101, "http://t.net/a/")]
    labels = [(i, int(i % 2 == 0)) for i in range(100)]
    got = pathtree.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), []).collect()
    assert len(got) == len(rows)
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got if r["page_id"] < 100)


def brute_leak(text, item, budget):
    """Some window of the item occurs in the text within the budget (Sellers' algorithm)."""
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s.translate(LOWER)).encode()
    t, m = norm(text), norm(item)
    w, k, _ = budget.of(len(m))
    for s in range(len(m) - w + 1):
        d = list(range(w + 1))
        for c in t:
            e = [0]
            for i, p in enumerate(m[s : s + w], 1):
                e.append(min(d[i - 1] + (p != c), d[i] + 1, e[i - 1] + 1))
            if e[w] <= k:
                return True
            d = e
    return False


def test_short_items_are_found_as_words():
    items = [(1, "ab"), (2, "a b"), (3, "  Seven7 "), (4, "\t\n "), (5, ""), (6, "ab"), (7, "é")]
    index = qgram.GramIndex(items, qgram.Budget())
    for text in ("ab", "x ab y", "cab abc", "a  B", "SEVEN7!", "seven7", "a\nb ab", "é è", "", " ", "eé"):
        words = f" {re.sub(r'[\x20\x09-\x0D]+', ' ', text.translate(LOWER))} "
        want = {i for i, t in items if t.strip() and f" {t.strip().translate(LOWER)} " in words}
        found = index.leaks(np.frombuffer(text.encode(), dtype=np.uint8))
        assert {f[0] for f in found} == want
        assert all(text.encode()[a:b].decode().split() == next(t for i, t in items if i == k).lower().split() or text.lower() != text for k, _, a, b in found)


def test_long_stretches_equal_brute_force(monkeypatch):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    budget = qgram.Budget(window=50, rate=0.08, least=30)
    items = [(k, " ".join(word() for _ in range(14))) for k in range(3)]
    index = qgram.GramIndex(items, budget)
    for stretch in (1, 20, 90, 1 << 16):
        monkeypatch.setattr(qgram, "STRETCH", stretch)
        for _ in range(12):
            # pieces of items that are no leak, side by side, and now and then a leak
            parts = [items[rng.randrange(3)][1][(a := rng.randint(0, 30)) : a + rng.choice([20, 35, 45, 52])] for _ in range(rng.randint(1, 12))]
            text = "".join(parts)
            want = {i for i, t in items if brute_leak(text, t, budget)}
            assert {f[0] for f in index.leaks(np.frombuffer(text.encode(), dtype=np.uint8))} == want


def test_leaks_equal_brute_force():
    rng = random.Random(8)
    budget = qgram.Budget(window=50, rate=0.08, least=30)
    item = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(14))
    index = qgram.GramIndex([(7, item)], budget)
    told = [0, 0]
    for _ in range(60):
        s = list(item[rng.randint(0, 8) : rng.randint(45, len(item))])
        for _ in range(rng.randint(0, 9)):
            q = rng.randrange(len(s))
            s[q : q + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        text = " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(6)) + " " + "".join(s) + " tail of it"
        want = brute_leak(text, item, budget)
        assert bool(index.leaks(np.frombuffer(text.encode(), dtype=np.uint8))) == want
        told[want] += 1
    assert min(told) > 5


def test_contaminated(spark, docs, odd):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the cellar of the old castle near the sea"
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None), (None, item), (4, item), (5, "tiny one here now")], "item_id long, text string")
    filler = "nothing to see here at all " * 400
    rows = [(10, filler + item.upper().replace(" ", "\n ") + " " + filler, "en", "s"), (11, filler, "en", "s"), (12, item[20:], "en", "s"), (13, "say tiny one here now!", "en", "s"), (14, None, "en", "s"), (None, item, "en", "s")]
    df = docs(rows).withColumn("l", F.lit(1)).withColumn("item_id", F.lit(2))
    got = sorted(((r["doc_id"] or -1, r["item_id"]) for r in qgram.contaminated(df, bench).collect()))
    assert got == [(-1, 1), (-1, 4), (10, 1), (10, 4), (12, 1), (12, 4), (13, 5)]
    found = next(r for r in qgram.contaminated(df, bench).collect() if r["doc_id"] == 10)
    data = rows[0][1].encode()
    assert b"QUICK" in data[found["first"] : found["end"]] and found["edits"] <= 8
    left = qgram.clean(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [11, 14]
    assert qgram.contaminated(odd, bench.limit(0)).count() == 0 and qgram.clean(odd, bench.limit(0)).count() == odd.count()
    assert qgram.contaminated(odd.limit(0), bench).count() == 0


def test_benchmark_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(qgram, "PART_BYTES", 64)
    items = [(i, " ".join(f"word{i}x{k}" for k in range(12))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(i, "before " + t + " after", "en", "s") for i, t in items])
    assert {(r["doc_id"], r["item_id"]) for r in qgram.contaminated(df, bench).collect()} == {(i, i) for i in range(6)}
    assert qgram.clean(df, bench).count() == 0
    monkeypatch.setattr(qgram, "GROUP", 1)
    assert {(r["doc_id"], r["item_id"]) for r in qgram.contaminated(df, bench).collect()} == {(i, i) for i in range(6)}
    assert qgram.clean(df.unionAll(docs([(9, "nothing here", "en", "s")])), bench).count() == 1
