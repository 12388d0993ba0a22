import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simweave.llm import hyperminhash as h
from simweave.llm import textkit as tk
from simweave.llm.components import components
from simweave.llm.sifting import anti_join, semi_join
from tests.llm import brute


def noisy(rng, words, rate, vocabulary):
    return [w if rng.random() >= rate else rng.choice(vocabulary) for w in words]


@pytest.mark.parametrize(("shingle", "length"), [(2, 60), (5, 300), (2, 1300)])
def test_components_equal_brute_force(spark, docs, shingle, length):
    rng = random.Random(length)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(length + rng.randint(-20, 20))]
        for _ in range(14):
            rows.append((len(rows), " ".join(noisy(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.06, 0.1, 0.2]), vocabulary)), "en", "s"))
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(["", "a", "A", "a b", "b a", "A B", " a\tb ", None])]
    want, sizes = brute.components([(r[0], r[1]) for r in rows], shingle, 80)
    got = {r["doc_id"]: r for r in h.near_duplicates(docs(rows), 0.8, shingle).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_large_buckets_and_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(h, "LARGE", 3)
    monkeypatch.setattr(h, "TILE", 8)
    monkeypatch.setattr(h, "STAR_ROUNDS", 1)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, " ".join(noisy(rng, base, rng.choice([0.02, 0.05, 0.08, 0.1]), vocabulary)), "en", "s") for i in range(70)]
    want, _ = brute.components([(r[0], r[1]) for r in rows], 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in h.near_duplicates(docs(rows), 0.8, 2).collect()}
    assert got == want


def test_estimate_is_corrected():
    rng = np.random.default_rng(1)
    for n, shared in ((40, 36), (500, 420), (4000, 3400)):
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = tk.mix(pool[:n]), tk.mix(pool[n - shared :])
        for part in (False, True) if n > h.SPLIT else (False,):
            ra, rb = (h.registers(np.unique(x), part)[None, :] for x in (a, b))
            j, told = h.estimate(ra, rb, np.array([n]), np.array([n]), np.array([part]))
            true = shared / (2 * n - shared)
            assert abs(j[0] - true) < 5 * (true * (1 - true) / told[0]) ** 0.5
    x, y = (tk.mix(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in range(2))
    rx, ry = (h.registers(np.unique(v), True)[None, :] for v in (x, y))
    assert abs(h.estimate(rx, ry, np.array([5000]), np.array([5000]), np.array([True]))[0][0]) < 0.03


def test_odd_rows(spark, odd):
    extra = odd.withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("id", F.lit(3))
    rows = h.near_duplicates(extra, 0.8, 5).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {i: by[i][0]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert len(by[5]) == 2 and all(r["component_id"] is None and r["kept"] for r in by[None])
    assert h.near_duplicates(odd.limit(0), 0.8, 5).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 2), (None, 1)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_sifting(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(2000)] + [(3, "again"), (None, "null")], "doc_id long, row string").withColumn("near", F.lit(1))
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] + [(3,), (3,)], "doc_id long")
    want = {*range(0, 3000, 7), 3}
    kept = semi_join(rows, ids, "doc_id")
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([i for i in range(2000) if i in want] + [3])
    rest = [r["doc_id"] for r in anti_join(rows, ids, "doc_id").collect()]
    assert sorted(x for x in rest if x is not None) == [i for i in range(2000) if i not in want] and rest.count(None) == 1
    assert semi_join(rows, ids.limit(0), "doc_id").count() == 0 and anti_join(rows, ids.limit(0), "doc_id").count() == 2002


def test_tiles_bring_components_together_and_stay_small(spark):
    rng = random.Random(3)
    rows = [(1, False, i, 0 if i < 900 else rng.randint(1, 40), 10, 0) for i in range(1000)]  # most are of one component
    rows += [(2, True, i, i, 10, 0) for i in range(60)]  # all differ
    rows += [(3, True, i, i % 2, 20_000, 0) for i in range(40)]  # long texts
    members = spark.createDataFrame(rows, "key long, part boolean, id long, comp long, n long, band int")
    cells, copies = {}, {}
    for r in h._tiles(members, 50, 400_000).collect():
        cells.setdefault((r["key"], r["ta"], r["tb"]), []).append(r)
        copies[r["key"]] = copies.get(r["key"], 0) + 1
    met = set()
    for (key, ta, tb), rs in cells.items():
        assert len(rs) <= 160 and sum(4 * r["n"] for r in rs) <= 2_000_000
        met |= {(key, a["id"], b["id"]) for a in rs for b in rs if ta == tb or a["side"] != b["side"]}
    for key in (1, 2, 3):
        mine = [r for r in rows if r[0] == key]
        assert all((key, a[2], b[2]) in met for a in mine for b in mine if a[3] != b[3])
    assert copies[1] <= 2 * 900 + 100 * 25 and len([c for c in cells if c[0] == 3]) >= 4


def test_a_bucket_of_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(h, "LARGE", 4)
    monkeypatch.setattr(h, "STAR_ROUNDS", 1)
    rng = random.Random(15)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(20_000)]
    rows = [(i, " ".join(noisy(rng, base, [0.01, 0.05, 0.09, 0.3][i % 4], vocabulary)), "en", "s") for i in range(16)]
    want, _ = brute.components([(r[0], r[1]) for r in rows], 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in h.near_duplicates(docs(rows), 0.8, 2).collect()} == want
