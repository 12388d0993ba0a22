import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simweave.llm import cotrain, crf, fitting, ftrl


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def words(rng, n, alphabet="abcdefgh"):
    return [rng.choice(alphabet) + rng.choice(alphabet) + rng.choice(alphabet) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    bad = ["grump", "snarl", "growl"]
    rows = []
    for i in range(600):
        w = words(rng, rng.randint(20, 80))
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity(spark, docs, texts):
    df = docs([(i, t, "en", "s") for i, t, _ in texts])
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in texts], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ftrl.toxicity(df, labels).collect()}
    held = [i for i, _, _ in texts if fold(i, 4) == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == texts[i][2] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_labels_of_the_held_out_fold_are_not_used(spark, docs, texts):
    df = docs([(i, t, "en", "s") for i, t, _ in texts[:200]])
    make = lambda flip: spark.createDataFrame([(i, int(x != (flip and fold(i, 4) == 2))) for i, _, x in texts[:200]], "doc_id long, toxic int")
    a, b = ({r["doc_id"]: r["score"] for r in ftrl.toxicity(df, make(flip)).collect()} for flip in (False, True))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (1, 0), (4, 0)], "doc_id long, toxic int")
    rows = ftrl.toxicity(odd.withColumn("score", F.lit(1)), labels).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and r["predicted"] is not None and r["held_out"] is not None for r in rows)
    assert all(r["score"] == 0.5 for r in ftrl.toxicity(odd, labels.limit(0)).collect())
    assert ftrl.toxicity(odd.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def mixed_quality():
    rng = random.Random(2)
    rows = []
    for i in range(500):
        kind = i % 6
        w = words(rng, rng.randint(30, 120), "abcdefghijklmnop")
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1 and i % 12 == 1:
            w = [x for x in w[:8] for _ in range(12)]
        bad = kind == 0 or (kind == 1 and i % 12 == 1)
        rows.append((i, " ".join(w), not bad))
    return rows


def test_quality(spark, docs, mixed_quality):
    df = docs([(i, t, "en", f"s{i % 3}") for i, t, _ in mixed_quality])
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in mixed_quality if i % 2 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cotrain.quality(df, labels).collect()}
    held = [i for i, _, _ in mixed_quality if fold(i, 5) == 0]
    assert np.mean([got[i]["keep"] == mixed_quality[i][2] for i in held]) > 0.9
    extra = df.withColumn("_quality", F.lit(1))
    left = cotrain.kept(extra, labels)
    assert left.columns == extra.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["keep"]}


def test_quality_learns_from_all_unlabelled_rows(spark, docs, monkeypatch):
    rng = random.Random(12)
    good = lambda: " ".join(words(rng, 60, "abcdefghijklmnop"))
    bad = lambda: " ".join(w.upper() + "!!" for w in words(rng, 60, "abcdefghijklmnop"))
    rows = [(i, good() if i % 2 else bad(), "en", f"s{i % 3}") for i in range(7000)]
    read = spark.sparkContext.accumulator(0)
    real = cotrain._sure

    def counting(model, least):
        run = real(model, least)

        def counted(batches):
            def each():
                for b in batches:
                    read.add(b.num_rows)
                    yield b

            yield from run(each())

        return counted

    monkeypatch.setattr(cotrain, "_sure", counting)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    settings = cotrain.CoTraining(rounds=2, epochs=2)
    got = cotrain.quality(docs(rows), labels, max_taught=20, settings=settings).collect()
    pool = sum(fold(i, 5) != 0 for i in range(200, 7000))
    assert 2 * pool <= read.value <= 2.1 * pool
    assert np.mean([r["keep"] == bool(r["doc_id"] % 2) for r in got]) > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (8, 0), (1, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = cotrain.quality(odd, some).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in rows)
    assert cotrain.quality(odd.limit(0), labels).count() == 0
    assert cotrain.quality(odd.select("doc_id", "text"), labels).count() == odd.count()


VOICES = {"xx": "aeiou", "yy": "bcdfg", "zz": "mnpqrs"}


def voice(rng, lang, n):
    return [" ".join("".join(rng.choice(VOICES[lang]) for _ in range(rng.randint(2, 7))) for _ in range(1)) for _ in range(n)]


def test_language(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(voice(rng, lang, rng.randint(40, 90))), lang, "s") for i in range(240) for lang in [list(VOICES)[i % 3]]]
    df = docs(rows)
    fit = crf.CrfFit(steps=60)
    got = {r["doc_id"]: r for r in crf.identify(df, settings=fit).collect()}
    held = [r for r in rows if fold(r[0], 5) == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    switched = docs([(900, " ".join(voice(rng, "xx", 30) + voice(rng, "zz", 50) + voice(rng, "yy", 20)), None, "s")])
    runs = crf.code_switches(switched, train=df, settings=fit).first()["segments"]
    assert [r["lang"] for r in runs] == ["xx", "zz", "yy"]
    assert abs(runs[0]["end"] - 30) <= 2 and abs(runs[1]["end"] - 80) <= 2 and runs[2]["end"] == 100


def test_language_of_short_texts(spark, docs):
    rng = random.Random(13)
    rows = [(i, " ".join(voice(rng, lang, rng.randint(2, 9) if lang == "zz" else 60)), lang, "s") for i in range(180) for lang in [list(VOICES)[i % 3]]]
    got = {r["doc_id"]: r["lang_pred"] for r in crf.identify(docs(rows), settings=crf.CrfFit(steps=40)).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows if fold(r[0], 5) == 0 and r[2] == "zz"]) > 0.9


def test_language_of_odd_rows(spark, odd):
    fit = crf.CrfFit(steps=5)
    rows = crf.identify(odd, settings=fit).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 8):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (6, 7)} <= {"en", "de", "fr"}
    none = crf.identify(odd.withColumn("lang", F.lit(None).cast("string")), settings=fit).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert crf.identify(odd.limit(0), settings=fit).count() == 0


def test_columns_with_clashing_names_are_ignored(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(voice(rng, lang, 30)), lang, f"s{i % 3}") for i in range(90) for lang in [list(VOICES)[i % 3]]]
    df = docs(rows)
    names = ("key", "y", "letters", "size", "class", "share", "cut", "nth", "upto", "t", "r", "feats", "bucket", "near", "row", "slot", "held_out", "score", "z0")
    more = df.selectExpr("*", *[f"'{n}' as {n}" for n in names])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 1)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    plain = lambda x: sorted(map(tuple, x.collect()))
    fit = crf.CrfFit(steps=10)
    assert plain(crf.identify(more, settings=fit)) == plain(crf.identify(df, settings=fit))
    assert plain(ftrl.toxicity(more, labels.withColumn("y", F.lit(9)))) == plain(ftrl.toxicity(df, labels))
    short = cotrain.CoTraining(rounds=1, epochs=2)
    assert plain(cotrain.quality(more, labels.withColumn("y", F.lit(9)), settings=short)) == plain(cotrain.quality(df, labels, settings=short))
    assert cotrain.kept(more, labels, settings=short).columns == more.columns


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    off = np.array([0, 0, 1, 2, 130, 194, 300])
    e, trans = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    p = crf.posteriors(e, off, trans)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b > a:
            up, down = [e[a]], [np.zeros(3)]
            for t in range(a + 1, b):
                up.append(np.logaddexp.reduce(up[-1][:, None] + trans, axis=0) + e[t])
            for t in range(b - 1, a, -1):
                down.append(np.logaddexp.reduce(trans + (e[t] + down[-1])[None, :], axis=1))
            x = np.array(up) + np.array(down[::-1])
            x = np.exp(x - x.max(axis=1, keepdims=True))
            assert np.allclose(p[a:b], x / x.sum(axis=1, keepdims=True), atol=1e-9)


def test_sequences_gradient():
    rng = np.random.default_rng(1)
    psi, trans = rng.uniform(0.2, 2, size=(3, 5, 3)), rng.normal(size=(3, 3))
    y = rng.integers(0, 3, size=(3, 5))

    def likelihood(t):
        total = 0.0
        for s, labels in zip(psi, y, strict=True):
            a = s[0]
            for x in s[1:]:
                a = (a @ np.exp(t)) * x
            path = np.prod([s[i, c] for i, c in enumerate(labels)]) * np.prod([np.exp(t[i, j]) for i, j in zip(labels, labels[1:], strict=False)])
            total += np.log(path / a.sum())
        return total

    _, g = crf._gradient(psi, np.exp(trans), y)
    for i in range(3):
        for j in range(3):
            d = np.zeros((3, 3))
            d[i, j] = 1e-5
            assert (likelihood(trans + d) - likelihood(trans - d)) / 2e-5 == pytest.approx(g[i, j], abs=1e-4)


def test_the_sample_is_bounded_where_one_id_has_most_rows(spark, docs):
    rows = spark.range(50000).selectExpr("7L as doc_id", "concat('row ', id) as text").unionAll(spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(300)] + [(7, 1.0)] * 40000 + [(8, 1.0)], "doc_id long, y double")
    picked = fitting.sample(rows, labels, 100, 1 << 20)
    got = picked.collect()
    assert len(got) == 100 and len({r["doc_id"] for r in got}) == 100 and 8 not in {r["doc_id"] for r in got}
    assert fitting.one_each(fitting.rows_of(rows, picked)).count() == 100
    everything = fitting.sample(rows, labels, 1000, 1 << 20)
    assert everything.count() == 299  # all but the one with two labels
    assert fitting.one_each(fitting.rows_of(rows, everything)).count() == 299


def test_the_sample_is_bounded_in_bytes_and_even(spark):
    rows = spark.createDataFrame([(i, "x" * (2000 if i % 10 == 0 else 50)) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "rare" if i % 100 == 1 else "often") for i in range(1000)], "doc_id long, y string")
    picked = fitting.sample(rows, labels, 40, 64 * 500, even=True).join(rows, "doc_id").collect()
    assert sum(r["y"] == "rare" for r in picked) == 10 and len(picked) == 40 and all(len(r["text"]) == 50 for r in picked)
    few = fitting.sample(rows, labels, 1000, 64 * 100).join(rows, "doc_id").collect()
    assert 6400 - 50 < sum(len(r["text"]) for r in few) <= 6400
    assert fitting.sample(rows, labels.limit(0), 40, 6400, even=True).count() == 0


def test_ftrl_follows_the_published_update(spark):
    """The update by coordinate, one number at a time, against the vectorised one."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, size=rng.integers(1, 9))) for _ in range(60)]
    y = rng.integers(0, 2, size=60).astype(float)
    s = ftrl.Ftrl(alpha=0.5, beta=1.0, l1=0.3, l2=0.7, passes=3)
    w, bias = s.fit(rows, y, 40)
    z, n, start = [0.0] * 40, [0.0] * 40, float(np.log((y.sum() + 1) / (60 - y.sum() + 1)))
    b, z0, n0 = start, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    order = np.random.default_rng(2)
    for _ in range(s.passes):
        for k in order.permutation(60):
            now = {i: weight(i) for i in rows[k]}
            g = 1 / (1 + np.exp(-(b + sum(now.values())))) - y[k]
            for i, wi in now.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
            sigma = ((n0 + g * g) ** 0.5 - n0**0.5) / s.alpha
            z0 += g - sigma * (b - start)
            n0 += g * g
            b = start - z0 / ((s.beta + n0**0.5) / s.alpha)
    assert np.allclose(w, [weight(i) for i in range(40)]) and bias == pytest.approx(b)
    assert 0 < np.count_nonzero(w) < 40


def plain_view(rows, y, size, s):
    """Logistic regression by Adagrad, dense and row by row, with the same batches."""
    x = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        for f, v in row:
            x[i, f] += v
    w, b, g2, h2 = np.zeros(size), 0.0, np.full(size, 1e-3), 1e-3
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            at = order[k : k + 64]
            e = np.array([1 / (1 + np.exp(-(x[i] @ w + b))) - y[i] for i in at])
            seen = (x[at] != 0).any(axis=0)
            g = np.where(seen, e @ x[at] / len(at) + s.l2 * w, 0)
            g2 += g * g
            w -= s.rate * g / np.sqrt(g2)
            h2 += e.mean() ** 2
            b -= s.rate * e.mean() / np.sqrt(h2)
    return w, b


def test_views_follow_plain_adagrad():
    rng = np.random.default_rng(3)
    rows = [[(int(f), float(v)) for f, v in zip(rng.choice(30, 6, replace=False), rng.uniform(0.1, 2, 6), strict=True)] for _ in range(150)]
    y = rng.integers(0, 2, 150).astype(float)
    s = cotrain.CoTraining(epochs=3)
    bounds = np.arange(0, 901, 6)
    view = cotrain.View(bounds, np.array([f for r in rows for f, _ in r]), np.array([v for r in rows for _, v in r]), 30)
    view.fit(np.arange(150), y, s)
    w, b = plain_view(rows, y, 30, s)
    assert np.allclose(view.w[:-1], w) and view.w[-1] == pytest.approx(b)
    assert np.allclose(view.logits(np.array([5, 2])), [sum(w[f] * v for f, v in rows[i]) + b for i in (5, 2)])


def test_calibration_is_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    c = cotrain._platt(x, y)
    loss = lambda c: -np.sum(y * (z := np.column_stack([x, np.ones(300)]) @ c) - np.logaddexp(0, z)) + 0.5e-2 * c @ c
    assert all(loss(c) <= loss(c + d) + 1e-9 for d in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3)


def test_each_view_teaches_the_other_what_it_is_surest_of(spark, docs, mixed_quality, monkeypatch):
    """One round by hand: the first models' logits, the surest of each class, and who is taught."""
    df = docs([(i, t, "en", f"s{i % 3}") for i, t, _ in mixed_quality])
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in mixed_quality if i % 4 == 0], "doc_id long, quality int")
    models, told, real = [], [], cotrain._train

    def spy(s, taught):
        told.append({k: list(v) for k, v in taught.items()})
        return real(s, taught)

    fit = cotrain.fit_in_one_task
    monkeypatch.setattr(cotrain, "_train", spy)
    monkeypatch.setattr(cotrain, "fit_in_one_task", lambda *a: models.append(fit(*a)) or models[-1])
    cotrain.quality(df, labels, max_taught=10, settings=cotrain.CoTraining(rounds=1, epochs=3)).count()
    assert len(models) == 2 and told[0] == {} and 0 < len(told[1]) <= 22  # a class each rounds up
    m = dict(np.load(io.BytesIO(models[0])))
    pool = [(i, t) for i, t, _ in mixed_quality if i % 4 and fold(i, 5) != 0]
    rows = df.where(F.col("doc_id").isin([i for i, _ in pool])).withColumn("key", F.xxhash64("doc_id", "text")).toPandas().sort_values("key")
    part = pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in ("text", "lang", "source", "n_chars")], names=["text", "lang", "source", "n_chars"])
    z, keys, least = cotrain._views(m, part), rows["key"].to_list(), np.log(0.95 / 0.05)
    want = {}
    for k in (0, 1):
        for label, share in ((1.0, m["rate"]), (0.0, 1 - m["rate"])):
            sign = 1 if label else -1
            order = sorted((-sign * z[k][i], keys[i]) for i in range(len(keys)) if sign * z[k][i] >= least)
            for _, key in order[: int(np.ceil(float(share) * min(0.1 * len(pool), 10)))]:
                want.setdefault(key, [np.nan, np.nan])[1 - k] = label
    same = lambda d: {k: [str(x) for x in v] for k, v in d.items()}
    assert same(told[1]) == same(want)


def test_a_view_is_not_asked_again_what_it_has_taught():
    """The taught keys come with the model: no join of them for each view and class."""
    from types import SimpleNamespace

    out = io.BytesIO()
    np.savez(out, text=np.full((1 << cotrain.BITS) + 1, 5.0), meta=np.full(cotrain.DENSE * (cotrain.BINS + 1) + 2 * cotrain.KINDS + 1, 5.0), edges=np.zeros((cotrain.DENSE, cotrain.BINS)))
    columns = [pa.array([1, 2, 3, 4]), pa.array([11, 12, 13, 14]), pa.array(["some words"] * 4), pa.array(["en"] * 4), pa.array(["a"] * 4), pa.array([10] * 4)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "text", "lang", "source", "n_chars"])
    done = [np.array([12, 13]), np.array([13])]
    got = [r for b in cotrain._sure(SimpleNamespace(value=(out.getvalue(), done)), 2.9)([batch]) for r in b.to_pylist()]
    assert [(r["key"], r["z0"] is None, r["z1"] is None) for r in got] == [(11, False, False), (12, True, False), (14, False, False)]
