"""The queries that SQL can express agree with it, on the supplied tables and on made ones."""

import random

import duckdb
import pytest

from simweave.llm import queries


def compare(spark, folder, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'" if not folder.startswith("/root/testdata") else f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    plain = lambda v: str(round(v, 9)) if isinstance(v, float) else str(v)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    q = db.sql(queries.oracle_sql()[name])
    names = list(q.columns)
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in q.fetchall())
    assert columns == sorted(names) and ours == theirs
    return ours


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_supplied_tables(spark, sf_dir, name):
    assert compare(spark, sf_dir, name, ("documents", "pages", "labels"))


def test_mix_with_repeats_and_nulls(spark, odd, tmp_path):
    odd.unionAll(odd.limit(7)).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), "op4_splitting_tree_mix", ("documents",))


def test_tree_that_rejects(spark, tmp_path):
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.example.org", "b.net", "b.net", "B.NET", "c.fr"])
        top = rng.choice(["news", "spam", "blog", "".join(rng.choice("abcdefghij") for _ in range(9))])
        deep = "/".join(rng.choice(["x", "y", "es", "12", "deadbeefdeadbeef"]) for _ in range(rng.randint(0, 9)))
        pages.append((i, rng.choice([f"http://{host}/{top}/{deep}/{i}.html?q", f"https://{host}/{top}/{i}", f"http://{host}", f"plain{i}", None]), ""))
        if i % 3:
            labels.append((i, int(top != "spam" and rng.random() < 0.9), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels + labels[:50] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = compare(spark, str(tmp_path), "op7_path_template_tree", ("pages", "labels"))
    assert {"allow", "block"} <= {r[-1] for r in rows} and any("spam" in r[2] and r[-1] == "block" and r[4] == "None" for r in rows)
