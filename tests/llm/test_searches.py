import numpy as np
import pytest
from pyspark.sql import functions as F

from simweave.llm import mih


def brute(ids, x, every, k):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = np.array([sum(a * b for a, b in zip(v, w, strict=True)) for w in x])
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(df, **options):
    got = {}
    for r in sorted(mih.nearest(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1))).astype(np.float32).astype(float)
    ids = np.arange(1500)
    got, want = run(table(spark, ids, x), every=20, k=20, block=400), brute(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(x[q] @ x[i]), abs=1e-12)


def test_ties_go_to_smaller_ids(spark):
    x = np.zeros((60, 4))
    x[:, 0] = 1
    got = run(table(spark, np.arange(60), x), every=20, k=20, block=16)
    assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("x", F.lit("y"))
    got = run(df, every=20, k=20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [20, 8, 1], 20: [0, 8, 1]}
    assert mih.nearest(df.limit(0)).count() == 0


def test_probing_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    codes = mih.learn(x[:300], longest, bits=64)
    index = mih.Index(codes, np.arange(700), x)
    queries = codes.encode(x[:5], True)
    for radius in (0, 3, 9, 17, 31):
        for code, found, probed in zip(queries, index.within(queries, radius), index.probe(queries, radius), strict=True):
            want = np.flatnonzero(mih._hamming(index.code, code[None, :]) <= radius)
            assert found.tolist() == want.tolist() and probed[want].all()
            if radius == 3:
                assert probed.mean() < 0.2  # probes of few errors reach few rows


def test_near_neighbours_are_found_by_few_probes():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(200, 32))
    x = np.repeat(centers, 20, axis=0) + 0.1 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    codes = mih.calibrate(mih.learn(x[:2000], longest, bits=256), x[:2000], 10, 0.97)
    index = mih.Index(codes, np.arange(4000), x)
    assert index.probe(codes.encode(x[:100], True), codes.radius).mean() < 0.5


def test_the_radius_falls_as_the_table_gets_denser():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = mih.learn(x, 1.0, bits=256)
    radius = [mih.calibrate(codes, x, 20 * 2000 / n, 0.95).radius for n in (2000, 40000)]
    assert radius[0] > radius[1]


def test_repeated_ids_have_one_answer(spark):
    rows = [(i, [1.0 + i % 7, float(i % 5)]) for i in range(1, 41)]
    df = spark.createDataFrame(rows + [(20, [9.0, 9.0])] * 3 + [(5, [0.5, 0.5])] * 500 + [(5, [8.0, 8.0])], "vec_id long, embedding array<float>")
    got = run(df, every=20, k=4)
    once = {i: min([v for j, v in rows if j == i] + ([[0.5, 0.5]] if i == 5 else [])) for i, _ in rows}
    assert got == run(spark.createDataFrame(list(once.items()), "vec_id long, embedding array<float>"), every=20, k=4)
    assert set(got) == {20, 40} and all(len({i for i, _ in v}) == 4 for v in got.values())


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in rng.normal(size=6 if i % 10 else 3 + i % 40)]) for i in range(1, 301)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=300)
    x = dict(rows)
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        want = {i: sum(a * b for a, b in zip(x[q], v, strict=False)) for i, v in x.items() if i != q}
        assert {i: pytest.approx(s) for i, s in found} == want
