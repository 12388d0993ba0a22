import random

import corpus_pipeline as cp
from tests.llm import brute


def test_stages(spark, tmp_path, sf_dir):
    import shutil

    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(30) for _ in range(5)]
    rows, junk, leaked = [], set(), set()
    for i in range(400):
        text = prose(rng.randint(60, 160))
        if i % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
            junk.add(i)
        elif i % 20 == 1:
            text = text + " " + rng.choice(items) + " " + prose(20)
            leaked.add(i)
        elif i % 10 == 3:
            text = rows[i - 1][1] + " " + prose(2)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = docs.columns, {r[0]: r[1] for r in rows}
    seen = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert name == "shard" or docs.columns == columns
    good, unique, clean, mix, last = seen
    assert set(good) == set(texts) - junk
    want, _ = brute.components([(i, texts[i]) for i in good], 5, 80)
    assert sorted(unique) == sorted(i for i in good if want[i] == i)
    assert set(clean) == set(unique) - leaked
    assert set(mix) <= set(clean) and sorted(mix) == sorted(last)
    assert cp.run(spark, str(tmp_path)).count() == len(last)
    shutil.rmtree(tmp_path / "mix")


def test_repeated_rows(spark, docs):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs([(1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", "b"), (3, "other text", "en", "b"), (None, None, None, None)])
    assert sorted((r["doc_id"] or 0) for r in cp.deduplicate(spark, df, "").collect()) == [0, 1, 3]


def test_rows_that_share_an_id_are_told_apart(spark, docs):
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, one, "en", "a"), (5, one + " end", "en", "a"), (5, other, "en", "b"), (5, other, "de", "a"), (6, "plain text", "en", "b"), (7, None, "en", "b"), (7, None, "en", "b"), (8, "", None, None), (None, one, "en", "a"), (None, one, "en", "a")]
    want = sorted(map(str, [(1, one, "en", "a"), (5, other, "de", "a"), (6, "plain text", "en", "b"), (7, None, "en", "b"), (8, "", None, None), (None, one, "en", "a"), (None, one, "en", "a")]))
    for df in (docs(rows), docs(rows[::-1]).repartition(5)):
        got = cp.deduplicate(spark, df, "")
        assert got.columns == df.columns and sorted(str(tuple(r)[:4]) for r in got.collect()) == want
    extra = docs(rows).selectExpr("*", "1 as name", "2 as again", "3 as row")
    assert cp.deduplicate(spark, extra, "").columns == extra.columns


def test_run_on_odd_and_empty_tables(spark, odd, tmp_path):
    for name, df in (("odd", odd), ("none", odd.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int").limit(3 if name == "odd" else 0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = cp.run(spark, f"{tmp_path}/{name}").collect()
        assert all(0 <= r["shard"] < 24 for r in got) and (len(got) == 0 if name == "none" else len(got) > 0)
