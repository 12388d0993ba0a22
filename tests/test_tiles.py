import random

from pyspark.sql import functions as F

from simweave.operators import pairs, similarity, verdicts
from simweave.operators.units import UNIT_DDL
from simweave.plans import registry


def units(spark, n, seed=5, kinds=("function",)):
    rng = random.Random(seed)
    rows = [(f"{i:03}", f"fn{i}", f"{i % 7}.js", i, i + rng.randint(0, 9), f"{i} code", rng.choice(kinds), None, [rng.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    return spark.createDataFrame(rows, UNIT_DDL)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def rows(df):
    return sorted(df.collect(), key=str)


def test_small_types_share_tiles(spark):
    u = units(spark, 120, kinds=[f"k{i}" for i in range(25)])
    assert rows(similarity.similar_pairs(u, 0.4, tile=16).select("left_id", "right_id")) == rows(similarity.similar_pairs_by_expression(u, 0.4).select("left_id", "right_id"))


def test_members_leave_with_their_pairs(spark, sf_dir):
    u = units(spark, 60)
    plain = pairs.with_members(similarity.similar_pairs(u, 0.4, tile=16), u)
    six = lambda df: rows(df.select("id", F.round("similarity", 6), "unit_type", "left", "right"))
    assert six(pairs.similar_members(u, 0.4)) == six(plain) != []
    assert joins(registry.queries()["pair_members"](spark, sf_dir)) == 0


def test_prompts_form_where_units_meet(spark, sf_dir):
    u = units(spark, 60)
    texts = spark.createDataFrame([(f"{i}.js", "é" * i) for i in range(5)], "file_path string, text string")
    found = similarity.similar_pairs(u, 0.4)
    side = lambda s: u.select(F.col("id").alias(f"{s}_id"), F.col("file_path").alias(f"{s}_file"))
    pairs_of = found.join(side("left"), "left_id").join(side("right"), "right_id").withColumn("similarity", F.format_string("%.6f", F.round("similarity", 6)))
    want = {(r["left_id"], r["right_id"]): r["prompt"] for r in verdicts.prompted(pairs_of, u, texts).collect()}
    got = verdicts.similar_prompts(u, texts, 0.4)
    assert {(r["left_id"], r["right_id"]): r["prompt"] for r in got.collect()} == want
    assert want
    hashed = verdicts.similar_prompts(u, texts, 0.4, digest="md5")
    assert rows(hashed.select("left_id", "prompt")) == rows(got.select("left_id", F.md5("prompt").alias("prompt")))
    assert verdicts.six_places(0.3000005) == "0.300001" and verdicts.six_places(1 / 3) == "0.333333"
    assert joins(registry.queries()["verdict_prompts"](spark, sf_dir)) == 0


def family(spark):
    """Classes, functions and blocks: some without parents, some with parents without vectors, blocks inside one another."""
    rng = random.Random(9)
    v = lambda: [rng.gauss(0.4, 1) for _ in range(4)]
    out = [(f"c{i}", "c", f"{i}.js", 0, 99, "", "class", None, None if i == 2 else v()) for i in range(4)]
    out += [(f"f{i:02}", "f", f"{i % 5}.js", i, i + 9, "", "function", rng.choice(["c0", "c1", "c2", "c3", None, "gone"]), None if i % 9 == 4 else v()) for i in range(40)]
    out += [(f"b{i:02}", "b", f"{i % 5}.js", (s := rng.randint(0, 30)), s + rng.randint(0, 20), "", "block", rng.choice(["f01", "f04", "f07", "f09", "c1", None]), v()) for i in range(70)]
    return spark.createDataFrame(out, UNIT_DDL)


def test_scores_form_where_units_meet(spark, sf_dir, monkeypatch):
    u = family(spark)
    plain = lambda *a, **b: similarity.similar_pairs(*a, **b)  # noqa: E731  another kernel: its pairs look up their ancestors
    some = u.where("id like '%3'").select("id")
    six = lambda df: [(*r[:3], round(r[3], 6), round(r[4], 6)) for r in rows(df)]
    monkeypatch.setattr(pairs, "SCORED", 16)
    for dirty in (None, some):
        got = six(pairs.weighted_pairs(u, 0.3, dirty))
        assert got == six(pairs.weighted_pairs(u, 0.3, dirty, kernel=plain))
        assert {r[2] for r in got} >= {"block", "function"}
    assert joins(registry.queries()["weighted_function_similarity"](spark, sf_dir)) == 0


def test_children_meet_in_tiles(spark, sf_dir, monkeypatch):
    u = family(spark).withColumn("embedding", F.when(F.col("id") == "b09", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).otherwise(F.col("embedding")))
    names = ["c0", "c1", "c2", "c3", "f01", "f04", "f07", "f09", "zz"]
    ends = spark.createDataFrame([(a, b) for a in names for b in names], "lp string, rp string")
    monkeypatch.setattr(pairs, "TILE", 8)
    monkeypatch.setattr(pairs, "SLICE", 3)
    got = {}
    for few in (0, 10**9):  # each pair by itself, all in tiles
        monkeypatch.setattr(pairs, "FEW", few)
        got[few] = {(r["lp"], r["rp"]): round(r["similarity"], 6) for r in pairs.child_similarity(ends, u).collect()}
    assert got[0] == got[10**9]
    assert len(got[0]) == 81 and got[0]["c0", "zz"] == 0 and got[0]["c0", "c0"] == 1
    plan = registry.queries()["child_max_similarity"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan


def test_native_products_are_compiled(spark, sf_dir):
    plan = registry.queries()["cosine_pairs_native"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "zipwith" not in plan.lower()
