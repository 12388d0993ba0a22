"""Weighted similarity of pairs from a unit's own vector and its ancestors'."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.functions.labels import id_key
from simweave.operators.similarity import SLICE, TILE, cosine, in_order, marked, similar_pairs, stacked, unit_rows
from simweave.operators.tiles import ROWS, meet
from simweave.operators.units import embedded, with_parents
from simweave.scratch import materialize

#: The weight of a unit's own similarity and of its ancestors', by type.
WEIGHTS = {"class": {"self": 1.0}, "function": {"self": 0.8, "class": 0.2}, "block": {"self": 0.7, "function": 0.2, "class": 0.1}}
#: Thresholds without configuration, by type.
DEFAULT_THRESHOLDS = {"class": 0.88, "function": 0.88, "block": 0.88}
#: Rows of a tile whose pairs are scored, and pairs scored at once.
SCORED = 4096
AT_ONCE = 8192
#: Children of parents are compared in tiles unless their pairs are fewer than one in so many of all.
FEW = 200


@dataclass(frozen=True)
class Thresholds:
    function: float
    block: float
    klass: float

    @classmethod
    def of(cls, threshold: float | None) -> Thresholds:
        """Clamped to [0, 1]; blocks and classes keep their default distance from functions, added in this order."""
        base = DEFAULT_THRESHOLDS["function"] if threshold is None else min(1.0, max(0.0, threshold))
        far = lambda t: min(1.0, max(0.0, base + DEFAULT_THRESHOLDS[t] - DEFAULT_THRESHOLDS["function"]))
        return cls(base, far("block"), far("class"))

    def column(self, unit_type: Column) -> Column:
        return F.when(unit_type == "class", self.klass).when(unit_type == "block", self.block).otherwise(self.function)


def self_bound(unit_type: str, threshold: float) -> float:
    """The least own similarity with which a pair can reach the threshold if all ancestors agree fully."""
    w = WEIGHTS[unit_type]
    total = sum(w.values())
    return (threshold * total - (total - w["self"])) / w["self"]


def nested_blocks(l_type: Column, lf: Column, ls: Column, le: Column, rf: Column, rs: Column, re: Column) -> Column:
    """Two blocks of one file of which one contains the other."""
    return (l_type == "block") & (lf == rf) & (((ls <= rs) & (le >= re)) | ((rs <= ls) & (re >= le)))


def child_similarity(parents: DataFrame, units: DataFrame) -> DataFrame:
    """``parents`` (lp, rp) -> (lp, rp, similarity): the largest similarity of their embedded children of one type, 0 without."""
    ends = parents.select("lp", "rp").distinct()
    asked = ends.select(F.col("lp").alias("parent_id")).unionAll(ends.select("rp")).distinct()
    kids = materialize(units.where(embedded(F.col("embedding"))).join(asked, "parent_id", "left_semi").select("parent_id", "unit_type", "embedding"), "children")
    sizes = kids.groupBy("parent_id", "unit_type").agg(F.count("*").alias("n"))
    l, r = sizes.select(F.col("parent_id").alias("lp"), "unit_type", F.col("n").alias("ln")), sizes.select(F.col("parent_id").alias("rp"), "unit_type", F.col("n").alias("rn"))
    wanted = ends.join(l, "lp").join(r, ["rp", "unit_type"]).agg(F.sum(F.col("ln").cast("double") * F.col("rn"))).first()[0] or 0.0
    n = sizes.agg(F.sum("n").cast("double")).first()[0] or 0.0
    if wanted * FEW < n * n:  # few of all pairs: each by itself
        l, r = kids.select(F.col("parent_id").alias("lp"), "unit_type", F.col("embedding").alias("le")), kids.select(F.col("parent_id").alias("rp"), "unit_type", F.col("embedding").alias("re"))
        best = ends.join(l, "lp").join(r, ["rp", "unit_type"]).groupBy("lp", "rp").agg(F.max(cosine(F.col("le"), F.col("re"))).alias("similarity"))
        return ends.join(best, ["lp", "rp"], "left").fillna(0.0, ["similarity"])
    found = meet(kids.withColumn("dirty", F.lit(True)), F.struct("parent_id", "embedding"), _best, "lp string, rp string, similarity double", TILE)
    best = found.groupBy("lp", "rp").agg(F.max("similarity").alias("similarity")).withColumnsRenamed({"lp": "_l", "rp": "_r"})
    return ends.join(best, (F.least("lp", "rp") == F.col("_l")) & (F.greatest("lp", "rp") == F.col("_r")), "left").select("lp", "rp", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def _best(a: pa.Table, b: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """The largest similarity of the rows of each two parents in two tiles, or within one."""
    def sides(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Parents in order, where the rows of each begin, the rows' vectors."""
        t = t.sort_by("parent_id").combine_chunks()
        names = t.column("parent_id").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        return names.dictionary, np.flatnonzero(np.diff(codes, prepend=-1)), unit_rows(t.column("embedding").combine_chunks())

    lnames, lfirst, x = sides(a)
    rnames, rfirst, y = (lnames, lfirst, x) if b is None else sides(b)
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
    of = np.searchsorted(lfirst, np.arange(len(x)), side="right") - 1
    for k in range(0, len(x), SLICE):
        most = np.maximum.reduceat(x[k : k + SLICE] @ y.T, rfirst, axis=1)
        here, begin = np.unique(of[k : k + SLICE], return_index=True)
        most = np.maximum.reduceat(most, begin, axis=0)
        i, j = np.repeat(here, len(rfirst)), np.tile(np.arange(len(rfirst)), len(here))
        s, l, r = most.ravel(), lnames.take(pa.array(i)), rnames.take(pa.array(j))
        swap = pc.greater(l, r)
        made = pa.RecordBatch.from_arrays([pc.if_else(swap, r, l), pc.if_else(swap, l, r), pa.array(s)], names=["lp", "rp", "similarity"])
        for n in range(0, made.num_rows, ROWS):
            yield made.slice(n, ROWS)


def _score(limits: dict[str, float]):
    """Pairs of two tiles by their weighted similarity: own vectors and those of ancestors side by side, so one product is the score."""

    def run(a: pa.Table, b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        rows, rank, second = stacked(a, b)
        kind = rows.column("unit_type")[0].as_py()
        limit, own = limits[kind], WEIGHTS[kind]["self"]
        of = lambda c: rows.column(c).combine_chunks()
        # an ancestor without a vector has similarity 0
        far = [(w, np.asarray(pc.is_valid(of(f"{k}_id"))), unit_rows(pc.fill_null(of(f"{k}_v"), []))) for k, w in WEIGHTS[kind].items() if k != "self"]
        x, touched = unit_rows(of("embedding")), of("dirty").to_numpy(zero_copy_only=False)
        path, start, end = of("file_path").dictionary_encode(null_encoding="encode").indices.to_numpy(), of("start_line").to_numpy(zero_copy_only=False), of("end_line").to_numpy(zero_copy_only=False)
        groups = sum((has.astype(int) << n for n, (_, has, _) in enumerate(far)), np.zeros(len(x), dtype=int))
        ours, theirs = np.arange(second or len(x)), np.arange(second, len(x))
        for ga in np.unique(groups[ours]):
            for gb in np.unique(groups[theirs]):
                common = [(w, v) for n, (w, _, v) in enumerate(far) if (ga & gb) >> n & 1]
                total = own + sum(w for w, _ in common)
                both = np.hstack([np.sqrt(own) * x, *[np.sqrt(w) * v for w, v in common]])
                left, right = ours[groups[ours] == ga], theirs[groups[theirs] == gb]
                beside = both[right].T
                for k in range(0, len(left), SLICE):
                    i, j = np.nonzero(both[left[k : k + SLICE]] @ beside >= limit * total - 1e-9)
                    l, r, keep = in_order(rank, left[i + k], right[j], b is None)
                    keep &= touched[l] | touched[r]
                    if kind == "block":
                        keep &= ~((path[l] == path[r]) & ((start[l] <= start[r]) & (end[l] >= end[r]) | (start[r] <= start[l]) & (end[r] >= end[l])))
                    l, r = l[keep], r[keep]
                    for n in range(0, len(l), AT_ONCE):
                        p, q = l[n : n + AT_ONCE], r[n : n + AT_ONCE]
                        alone = np.einsum("ij,ij->i", x[p], x[q])
                        s = (own * alone + sum(w * np.einsum("ij,ij->i", v[p], v[q]) for w, v in common)) / total if common else alone
                        hit = s >= limit
                        p, q = pa.array(p[hit]), pa.array(q[hit])
                        yield pa.RecordBatch.from_arrays([of("id").take(p), of("id").take(q), pa.repeat(pa.scalar(kind, pa.string()), len(p)), pa.array(alone[hit]), pa.array(s[hit])], names=["left_id", "right_id", "unit_type", "self_similarity", "similarity"])

    return run


def _weighted_in_tiles(units: DataFrame, limits: dict[str, float], dirty: DataFrame | None) -> DataFrame:
    """:func:`weighted_pairs` at depth 1: a unit takes its parent's vector along, so a pair is scored where it is found and only those that count leave."""
    needed = units.select("id", "unit_type", "parent_id", "embedding", "file_path", "start_line", "end_line")
    known = with_parents(needed.where(F.col("unit_type").isin(*limits)), of=needed)
    above = needed.where(F.col("unit_type").isin("function", "class")).select(F.col("id").alias("_up"), F.col("embedding").cast("array<double>").alias("_v"))
    known = known.join(above, F.coalesce("function_id", "class_id") == F.col("_up"), "left")
    vector = lambda k: F.when(F.col(f"{k}_id").isNotNull(), F.col("_v")).alias(f"{k}_v")
    known = known.select("id", "unit_type", "embedding", "file_path", "start_line", "end_line", "function_id", "class_id", vector("function"), vector("class"))
    rows = marked(known, dirty, *[c for c in known.columns if c not in ("id", "unit_type", "embedding")])
    return meet(rows, F.col("id"), _score(limits), "left_id string, right_id string, unit_type string, self_similarity double, similarity double", SCORED)


def weighted_pairs(units: DataFrame, threshold: float | None, dirty: DataFrame | None = None, depth: int = 1, kernel: Callable[..., DataFrame] = similar_pairs, types: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """Pairs of units of one type, one of ``types``, whose weighted similarity reaches its threshold.

    ``units`` as UNIT_DDL -> (left_id, right_id, unit_type, self_similarity,
    similarity), left_id < right_id. A pair of a type needs a vector on both
    sides. An ancestor counts if both sides have one of that type within
    ``depth`` steps: its similarity is that of their vectors, or, if one has
    none, the best of their children (nothing at depth 1, where an ancestor's
    children are out of sight). Blocks inside one another do not pair. Pairs
    that cannot reach the threshold even with equal ancestors leave before any
    ancestor is looked up. At threshold 0, pairs without vectors are not formed.
    """
    t = Thresholds.of(threshold)
    limit = {"class": t.klass, "function": t.function, "block": t.block}
    if depth == 1 and kernel is similar_pairs:
        return _weighted_in_tiles(units, {kind: limit[kind] for kind in types}, dirty)
    known = with_parents(units, depth)
    found = kernel(units.where(F.col("unit_type").isin(*types)), {kind: self_bound(kind, limit[kind]) - 1e-9 for kind in types}, dirty)
    side = lambda s: known.select(F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("file_path", "start_line", "end_line", "function_id", "class_id")])
    pairs = found.withColumnRenamed("similarity", "self_similarity").join(side("left"), "left_id").join(side("right"), "right_id")
    pairs = pairs.where(~nested_blocks(F.col("unit_type"), F.col("left_file_path"), F.col("left_start_line"), F.col("left_end_line"), F.col("right_file_path"), F.col("right_start_line"), F.col("right_end_line")))
    # read once for each kind of ancestor and once more: the products are not to be formed again
    pairs = materialize(pairs, "candidates")
    vectors = lambda s, of: units.select(F.col("id").alias(of), F.col("embedding").alias(f"{s}_v"))
    score, total = F.lit(0.0), F.lit(0.0)
    for kind in [k for k in ("function", "class") if any(k in WEIGHTS[t] for t in types if t != k)]:
        lp, rp = f"left_{kind}_id", f"right_{kind}_id"
        ends = pairs.where(F.col(lp).isNotNull() & F.col(rp).isNotNull() & F.col("unit_type").isin("block", "function")).select(F.col(lp).alias("lp"), F.col(rp).alias("rp")).distinct()
        with_v = ends.join(vectors("l", "lp"), "lp").join(vectors("r", "rp"), "rp")
        direct = with_v.where(embedded(F.col("l_v")) & embedded(F.col("r_v"))).select("lp", "rp", cosine(F.col("l_v"), F.col("r_v")).alias("similarity"))
        bare = with_v.where(~(embedded(F.col("l_v")) & embedded(F.col("r_v")))).select("lp", "rp")
        indirect = child_similarity(bare, units) if depth > 1 else bare.withColumn("similarity", F.lit(0.0))
        name = f"{kind}_similarity"
        pairs = pairs.join(direct.unionByName(indirect).select(F.col("lp").alias(lp), F.col("rp").alias(rp), F.col("similarity").alias(name)), [lp, rp], "left")
        weight = F.when(F.col("unit_type") == "block", WEIGHTS["block"][kind]).when(F.col("unit_type") == "function", WEIGHTS["function"].get(kind, 0.0)).otherwise(0.0)
        has = F.col(name).isNotNull()
        score = score + F.when(has, weight * F.col(name)).otherwise(0.0)
        total = total + F.when(has, weight).otherwise(0.0)
    own = F.when(F.col("unit_type") == "class", WEIGHTS["class"]["self"]).when(F.col("unit_type") == "block", WEIGHTS["block"]["self"]).otherwise(WEIGHTS["function"]["self"])
    final = pairs.withColumn("similarity", (own * F.col("self_similarity") + score) / (own + total))
    return final.where(F.col("similarity") >= t.column(F.col("unit_type"))).select("left_id", "right_id", "unit_type", "self_similarity", "similarity")


def with_members(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs as report rows: id, similarity and both sides as structs without vectors."""
    member = lambda s: units.select(F.col("id").alias(f"{s}_id"), F.struct("id", "name", "file_path", "start_line", "end_line", "code", "unit_type").alias(s))
    return pairs.join(member("left"), "left_id").join(member("right"), "right_id").select(id_key(F.col("left_id"), F.col("right_id")).alias("id"), "similarity", "unit_type", "left", "right")


def similar_members(units: DataFrame, threshold: float | dict[str, float], dirty: DataFrame | None = None) -> DataFrame:
    """The same rows for the pairs of :func:`similar_pairs`: members leave with their pair, none is looked up. ``code`` may be anything short that stands for it."""
    fields = ("id", "name", "file_path", "start_line", "end_line", "code", "unit_type")
    found = similar_pairs(units, threshold, dirty, carry=fields[1:-1])
    member = lambda s: F.struct(*[F.col("unit_type" if c == "unit_type" else f"{s}_{c}").alias(c) for c in fields]).alias(s)
    return found.select(id_key(F.col("left_id"), F.col("right_id")).alias("id"), "similarity", "unit_type", member("left"), member("right"))
