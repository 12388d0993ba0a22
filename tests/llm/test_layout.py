import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from simweave.llm import lines, mixing, resharding
from tests.llm.brute import WORD


def water(sizes, weights, most):
    """Targets by filling up in rounds."""
    target, open_, left = {}, dict(weights), float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w >= most * sizes[s]]
        if not full:
            return {**target, **{s: level * w for s, w in open_.items()}}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, docs, seed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en", rng.choice(["a", "b", "b", "b", "b", "b", "B", "é", None])) for i in range(400)]
    df = docs(rows).withColumn("key", F.lit(1)).withColumn("block", F.lit("x")).withColumn("size", F.lit(0))
    got = mixing.taken_words(df, seed=seed).collect()
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    order = sorted((s for s in totals if s is not None)) + [None]
    want = water(totals, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows)
    for s in totals:
        assert abs(taken[s] - want[s]) <= 0.5
    again = {r["doc_id"]: r["taken"] for r in mixing.taken_words(df.repartition(7), seed=seed).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    times = {}
    for r in mixing.mixed(df, seed=seed).collect():
        assert r.__fields__ == df.columns
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for r in got:
        if r["size"]:
            assert times.get(r["doc_id"], 0) == math.ceil(r["taken"] / r["size"])


def test_shards_are_disjoint_and_full(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    df = docs([(i, "w " * 10, "en", "ab"[i % 3 == 0]) for i in range(900)])
    _, _, blocks, depth = mixing.plan(df)
    assert depth == 7
    rows = [r for r in blocks.collect() if r["shards"]]
    counts = {}
    for r in rows:
        assert all(0 <= s < 128 for s in r["shards"])
        for s in r["shards"]:
            counts[s] = counts.get(s, 0) + 1
    draws = sum(counts.values())
    assert max(counts.values()) - draws / 128 <= 8 and len(counts) > 100


def test_running_sums_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(lines, "SALTS", 3)
    rng = random.Random(9)
    rows = [(rng.randint(0, 2), rng.randint(0, 99), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, h long, id long, v long")
    got = lines.running(df, ["g"], F.shiftright("h", 4), ["h", "id"], "v", "before").collect()
    for g, h, i, before in ((r["g"], r["h"], r["id"], r["before"]) for r in got):
        assert before == sum(v for a, b, j, v in rows if a == g and (b, j) < (h, i))
    numbers = {}
    for r in lines.numbered(df, ["g"]).collect():
        numbers.setdefault(r["g"], []).append(r["nth"])
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


def test_repeated_rows_are_cut_one_by_one(spark, docs):
    same, rest = [(7, "w " * 10, "en", "a")] * 40, [(100 + i, "w " * 5, "en", "b") for i in range(80)]
    for rows in (same + rest, same + rest + [(9, "v " * 300, "en", "c")] * 3):
        got = mixing.taken_words(docs(rows)).collect()
        for source in {r[3] for r in rows}:
            mine = [r for r in got if {7: "a", 9: "c"}.get(r["doc_id"], "b") == source]
            assert sum(r["taken"] for r in mine) == round(mine[0]["target"])
            assert len({r["taken"] // r["size"] for r in mine}) <= 2 and all(r["taken"] <= 3 * r["size"] for r in mine)
        times = {}
        for r in mixing.mixed(docs(rows)).collect():
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert times[7] == sum(math.ceil(r["taken"] / r["size"]) for r in got if r["doc_id"] == 7)


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.taken_words(odd.limit(0)).count() == 0
    blank = mixing.taken_words(odd.where("text is null"))
    assert {(r["size"], r["taken"], r["target"]) for r in blank.collect()} == {(0, 0, 0.0)}
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_hypergeometric_is_exact(spark):
    rows = spark.range(4000).selectExpr("(id + 0.5D) / 4000 as u", "20L as pop", "7L as good", "9L as draws")
    got = {r["x"]: r["n"] / 4000 for r in rows.selectExpr(mixing._hypergeometric("pop", "good", "draws", "u") + " as x").groupBy("x").agg(F.count("*").alias("n")).collect()}
    for x in range(8):
        assert got.get(x, 0) == pytest.approx(math.comb(7, x) * math.comb(13, 9 - x) / math.comb(20, 9), abs=1e-3)


def test_tree_keeps_counts(spark):
    n = [5, 0, 1000, 37, 1]
    leaves = mixing.split_tree(spark.createDataFrame([(n,)], "n array<long>"), 3, 1).collect()
    assert sorted(r["shard"] for r in leaves) == list(range(8))
    assert [sum(c) for c in zip(*(r["n"] for r in leaves), strict=True)] == n
    sizes = [sum(r["n"]) for r in leaves]
    assert max(sizes) - min(sizes) <= 3 and all(c >= 0 for r in leaves for c in r["n"])


def test_flow_is_least(spark):
    rng = random.Random(4)
    for _ in range(30):
        supply = [rng.randint(0, 4) for _ in range(3)]
        cuts = sorted(rng.randint(0, sum(supply)) for _ in range(2))
        demand = [cuts[0], cuts[1] - cuts[0], sum(supply) - cuts[1]]
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = resharding.min_cost_flow(supply, demand, cost)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
        best = math.inf
        for a, b, c, d in itertools.product(range(5), repeat=4):
            f = [[a, b, supply[0] - a - b], [c, d, supply[1] - c - d]]
            f.append([demand[j] - f[0][j] - f[1][j] for j in range(3)])
            if min(min(r) for r in f) >= 0:
                best = min(best, sum(f[i][j] * cost[i][j] for i in range(3) for j in range(3)))
        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best


def test_reshard(spark, docs):
    rng = random.Random(6)
    rows = [(i, "é" * rng.choice([0, 3, 10, 40, 400]), "en", "s") for i in range(1500)]
    df = docs(rows).withColumn("shard", F.lit(1)).withColumn("old", F.lit(9)).withColumn("key", F.lit(2))
    got = resharding.reshard(df).collect()
    by, total = {}, 0
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
        total += r["size"]
    assert sorted(by) == list(range(24)) and len(got) == len(rows)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    sums = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sums) - min(sums) <= max(r["size"] for r in got)  # documents are not cut
    old = [sum(r["size"] for r in got if r["old_shard"] == k) for k in range(16)]
    moved = sum(r["size"] for r in got if r["old_shard"] != r["shard"])
    assert moved == pytest.approx(sum(max(0, x - total / 24) for x in old), rel=0.05)
    assert all(r["old_shard"] == r["text_crc32"] % 16 for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in resharding.reshard(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_reshard_keeps_what_fits(spark, docs, tmp_path):
    df = docs([(i, "x" * 92, "en", "s") for i in range(240)])
    same = resharding.reshard(df, 4, 4, old=(F.col("doc_id") % 4).cast("int"))
    assert same.where("shard <> old_shard").count() == 0 and resharding.affected(same).count() == 0
    grown = resharding.reshard(df, 5, 4, old=(F.col("doc_id") % 4).cast("int"))
    assert grown.where("shard <> old_shard").count() == 48
    assert {r["shard"]: (r["rows_in"], r["rows_out"]) for r in resharding.affected(grown).collect()} == {0: (0, 12), 1: (0, 12), 2: (0, 12), 3: (0, 12), 4: (48, 0)}
    resharding.reshard(df, 5, 4, old=(F.col("doc_id") % 4).cast("int"), path=f"{tmp_path}/out").count()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 240 and {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()} == {(k, 48) for k in range(5)}


def test_rows_of_no_shard_are_placed(spark, docs):
    df = docs([(i, "x" * (i % 50), "en", "s") for i in range(100)])
    old = F.when(F.col("doc_id") % 5 < 3, F.col("doc_id") % 4).when(F.col("doc_id") % 5 == 3, F.lit(99)).cast("int")
    got = resharding.reshard(df, 6, 4, old=old).collect()
    assert len(got) == 100 and {r["old_shard"] for r in got} == {0, 1, 2, 3, None}
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(sums) == 6 and max(sums.values()) - min(sums.values()) <= 2 * 58


def test_equal_texts_stay_together(spark, docs):
    rng = random.Random(8)
    rows, i = [], 0
    for g in range(600):
        for _ in range(rng.choice([1, 1, 1, 2, 5, 9])):
            rows.append((i, f"text {g} " + "y" * rng.randint(1, 5) * (g % 30), "en", "s"))
            i += 1
    rows += [(i + k, "a text with very many copies", "en", "s") for k in range(1500)]
    got = resharding.reshard(docs(rows)).collect()
    where, size = {}, {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    share = sum(size.values()) / 24
    assert max(abs(x - share) for x in size.values()) <= share / 8
    most = zlib.crc32(b"a text with very many copies")
    assert all(len(shards) == 1 for text, shards in where.items() if text != most)
    assert len(where[most]) <= 16  # cut where shards are full only


def test_affected_shards_are_rewritten(spark, docs, odd, tmp_path):
    df = docs([(i % 200 if i % 7 else None, f"t{i % 50} " * (i % 40), "en", f"s{i % 3}") for i in range(600)]).unionByName(odd)
    got = resharding.reshard(df, path=f"{tmp_path}/out").collect()
    files = spark.read.parquet(f"{tmp_path}/out")
    names = {r["shard"] for r in resharding.affected(resharding.reshard(df)).collect()}
    wrote = files.select("row.*", "shard", "slot").collect()
    assert {r["shard"] for r in wrote} <= names and sum(r["shard"] not in names for r in got) + len(wrote) == len(got) == df.count()
    assert sorted(map(str, (tuple(r)[:5] for r in wrote))) == sorted(map(str, map(tuple, df.collect()))) or len(wrote) < len(got)
    assert sorted((r["shard"], r["slot"]) for r in got if r["shard"] in names) == sorted((r["shard"], r["slot"]) for r in wrote)
    assert sorted(map(str, got)) == sorted(map(str, resharding.reshard(df).collect()))


def test_reshard_of_odd_rows(spark, odd):
    rows = resharding.reshard(odd).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert resharding.reshard(odd.limit(0)).count() == 0
