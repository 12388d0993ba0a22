import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from simweave.operators import exclusions, incremental, pairs, score, similarity, verdicts
from simweave.operators.units import UNIT_DDL
from simweave.plans import report


def unit(i, vector, kind="function", path=None, start=1, end=3, parent=None, code=None):
    return (i, f"fn{i}", path or f"{i}.js", start, end, code or f"{i} code", kind, parent, vector)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), UNIT_DDL)


def found(df):
    return sorted((r["left_id"], r["right_id"]) for r in df.collect())


@pytest.mark.parametrize(
    ("vectors", "threshold", "expected"),
    [
        ([None, None], 0.8, []),
        ([[1, 0], [0, 1]], 0.9, []),
        ([[1, 0], [1, 0]], 0.7, [("0", "1")]),
        ([[1, 0], [0.9, 0], [0, 1]], 0.4, [("0", "1")]),
        ([[0, 0], [1, 0]], 0.1, []),
        ([[], [1.0]], 0.1, []),
    ],
)
def test_functions(spark, vectors, threshold, expected):
    rows = [unit(str(i), None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert found(pairs.weighted_pairs(frame(spark, *rows), threshold)) == expected


def test_nested_blocks_do_not_pair(spark):
    a = unit("1", [1.0, 0.0], "block", "f.java", 10, 40)
    assert found(pairs.weighted_pairs(frame(spark, a, unit("2", [1.0, 0.0], "block", "f.java", 20, 25)), 0.1)) == []
    assert found(pairs.weighted_pairs(frame(spark, a, unit("2", [1.0, 0.0], "block", "g.java", 20, 25)), 0.1)) == [("1", "2")]


def test_parents_weigh_in(spark):
    rows = [unit("c1", [1.0, 0.0], "class"), unit("c2", [0.0, 1.0], "class"), unit("f1", [1.0, 0.0], parent="c1"), unit("f2", [1.0, 0.0], parent="c2"), unit("f3", [1.0, 0.0], parent="c1")]
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in pairs.weighted_pairs(frame(spark, *rows), 0.5).where("unit_type = 'function'").collect()}
    assert got[("f1", "f2")] == pytest.approx(0.8)
    assert got[("f1", "f3")] == pytest.approx(1.0)


def test_grandparents_only_at_depth_two(spark):
    rows = [unit("c1", [1.0, 0.0], "class"), unit("c2", [0.0, 1.0], "class"), unit("f1", [1.0, 0.0], parent="c1"), unit("f2", [1.0, 0.0], parent="c2"), unit("b1", [1.0, 0.0], "block", parent="f1"), unit("b2", [1.0, 0.0], "block", parent="f2")]
    of = lambda depth: {r["left_id"]: r["similarity"] for r in pairs.weighted_pairs(frame(spark, *rows), 0.5, depth=depth).where("unit_type = 'block'").collect()}
    assert of(1)["b1"] == pytest.approx(1.0)
    assert of(2)["b1"] == pytest.approx(0.9)


def test_children_stand_in_for_a_bare_parent(spark):
    rows = [unit("c1", None, "class"), unit("c2", None, "class"), unit("f1", [1.0, 0.0], parent="c1"), unit("f2", [0.6, 0.8], parent="c2")]
    p = spark.createDataFrame([("c1", "c2"), ("c1", "zz")], "lp string, rp string")
    got = {r["rp"]: r["similarity"] for r in pairs.child_similarity(p, frame(spark, *rows)).collect()}
    assert got["c2"] == pytest.approx(0.6, abs=1e-6)
    assert got["zz"] == 0


def test_thresholds():
    t = pairs.Thresholds.of(0.8)
    assert t.function == 0.8
    assert t.block == t.klass == 0.8 + 0.88 - 0.88 != 0.8
    assert pairs.Thresholds.of(None).function == 0.88
    assert pairs.Thresholds.of(7).function == 1 and pairs.Thresholds.of(-1).block == 0


def test_tiles_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [unit(f"{i:03}", [rng.gauss(0, 1) for _ in range(5)], rng.choice(["function", "block"])) for i in range(90)]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[6] == b[6]:
            dot = sum(x * y for x, y in zip(a[8], b[8], strict=True))
            if dot / math.sqrt(sum(x * x for x in a[8]) * sum(x * x for x in b[8])) >= 0.5:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    u = frame(spark, *rows)
    assert set(found(similarity.similar_pairs(u, 0.5, tile=16))) == want
    assert set(found(similarity.similar_pairs_by_expression(u, 0.5))) == want
    dirty = spark.createDataFrame([("003",), ("017",), ("080",)], "id string")
    some = {p for p in want if set(p) & {"003", "017", "080"}}
    assert set(found(similarity.similar_pairs(u, 0.5, dirty, tile=16))) == some


def test_bulk_reuse(spark):
    rows = [unit(f"{i}", [((i % 10) + d) % 13 / 13 for d in range(64)]) for i in range(220)]
    u = frame(spark, *rows)
    first = pairs.weighted_pairs(u, 0.7)
    none = spark.createDataFrame([], "id string")
    again = pairs.weighted_pairs(u, 0.7, none)
    assert again.count() == 0
    paths = u.select(F.col("id"), "file_path")
    old = first.join(paths.select(F.col("id").alias("left_id"), F.col("file_path").alias("left_file")), "left_id").join(paths.select(F.col("id").alias("right_id"), F.col("file_path").alias("right_file")), "right_id")
    kept = incremental.reusable_pairs(old, u, spark.createDataFrame([], "file_path string"))
    assert kept.count() == first.count()


def test_score(spark):
    u = frame(spark, unit("1", [1.0, 0.0]), unit("2", [1.0, 0.0]))
    p = pairs.with_members(pairs.weighted_pairs(u, 0.4), u)
    s = score.duplication_score(p, u).first()
    assert (s["score"], s["grade"], s["total_lines"], s["duplicate_lines"], s["duplicate_groups"]) == (pytest.approx(50.0), "Critical", 6, 3, 1)
    empty = score.duplication_score(p.limit(0), u.limit(0)).first()
    assert (empty["score"], empty["grade"]) == (0, "Excellent")


def test_snapshot_diff(spark):
    ddl = "file_path string, checksum string, mtime double"
    current = spark.createDataFrame([("a", "1", 2.0), ("b", "1", 1.0), ("c", "1", 1.0), ("d", "1", 2.0)], ddl)
    tracked = spark.createDataFrame([("a", "0", 1.0), ("b", "0", 1.0), ("d", "1", 1.0), ("t", "1", 1.0)], ddl)
    got = {r["file_path"]: r["status"] for r in incremental.snapshot_diff(current, tracked).collect()}
    assert got == {"a": "changed", "b": "unchanged", "c": "added", "d": "unchanged", "t": "deleted"}


def test_verdicts(spark):
    ddl = "pair_key string, left_file string, right_file string, prompt string"
    p = spark.createDataFrame([(f"k{i}", f"l{i}", f"r{i}", ["yes", "No", "YES sir", None][i % 4]) for i in range(8)], ddl)
    cached = spark.createDataFrame([("k0", "no", "l0", "r0"), ("k1", "yes", "l1", "r1")], "pair_key string, verdict string, left_file string, right_file string")
    dirty = spark.createDataFrame([("r1",)], "file_path string")
    done, new = verdicts.classify(p, cached, dirty, lambda c: c, F.col("prompt"))
    got = {r["pair_key"]: r["verdict"] for r in done.collect()}
    assert got == {"k0": "no", "k1": "no", "k2": "yes", "k3": "yes", "k4": "yes", "k5": "no", "k6": "yes", "k7": "yes"}
    assert sorted(r["pair_key"] for r in new.collect()) == ["k1", "k2", "k4", "k5", "k6"]
    assert sorted(r["pair_key"] for r in verdicts.keep_true(done).collect()) == ["k2", "k3", "k4", "k6", "k7"]


@pytest.mark.parametrize("seed", range(15))
def test_clean_exclusions_against_all_pairs(spark, seed):
    import fnmatch

    rng = random.Random(seed)
    labels = [(rng.choice(["class", "function"]), rng.choice("abc") + rng.choice("12")) for _ in range(rng.randint(0, 6))]
    keys = list(dict.fromkeys(f"{rng.choice(['class', 'function', 'Block'])}|{rng.choice(['a*', 'b1', 'c2', '*', 'a1'])}|{rng.choice(['a1', 'b*', 'c2', '*2'])}" for _ in range(5)))

    def hit(kind, x, y, a, b):
        same = fnmatch.fnmatchcase if kind == "class" else str.__eq__
        return same(x, a) and same(y, b) or same(x, b) and same(y, a)

    want = [k for k in keys if (p := k.split("|"))[0] != "Block" and any(u[0] == v[0] == p[0] and hit(p[0], u[1], v[1], p[1], p[2]) for u, v in itertools.combinations(labels, 2))]
    df = spark.createDataFrame(labels, "unit_type string, label string")
    kept, removed = exclusions.clean_exclusions(keys, df)
    assert kept == want
    assert sorted(kept + removed) == sorted(keys)


def test_report_texts(spark):
    from datetime import UTC, datetime

    u = frame(spark, unit("1", [1.0, 0.0], code="\n".join(str(i) for i in range(20))), unit("2", [1.0, 0.0], code="<b>"))
    p = pairs.with_members(pairs.weighted_pairs(u, 0.4), u)
    at = datetime(2024, 5, 6, 7, 8, 9, 123000, tzinfo=UTC)
    doc = report.document(p, score.duplication_score(p, u), 0.4, at)
    assert report.file_name(at) == "dupes-2024-05-06T07-08-09-123Z.json"
    assert doc["version"] == 1 and doc["grade"] == "Critical" and len(doc["duplicates"]) == 1
    text = report.as_text(doc)
    assert "(5 more lines)" in text and "50.00%" in text
    assert "&lt;b&gt;" in report.as_html(doc) and '"generatedAt": "2024-05-06T07:08:09.123Z"' in report.as_json(doc)
    assert report.page(p, -5, 0).count() == 1
