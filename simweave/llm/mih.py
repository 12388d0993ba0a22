"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes of ``bits`` bits from learned rotations (iterative
quantization after Gong et al.: principal axes of a bounded sample, rotated so
that signs lose least). A code is split into substrings, and every substring
of every row is indexed. By the pigeonhole principle a code within Hamming
radius r agrees with the query in some substring up to r // m errors (one less
for all substrings but the first r % m + 1), so probing those values finds
every code within r (Norouzi et al., "Fast Exact Search in Hamming Space with
Multi-Index Hashing"). An index entry holds, as a bitmap, all rows that a probe
of its value must find, so a query is one entry of each substring's table.
Candidates are reranked by their inner product in double precision.

The radius is calibrated on the sample against brute force, at the density of
the whole table: the denser the table, the nearer its neighbours and the
smaller the radius. A query with too few codes inside it widens the radius
until it has enough.

Inner products of vectors of different length become angles by one more
coordinate, sqrt(M**2 - |x|**2) with M the greatest length, 0 for queries.

Data and queries are dealt out as blocks of bounded size; a task holds the
index of one block of data and answers one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simweave.scratch import materialize

#: Bits of a substring: a byte of the code.
SUBSTRING = 8
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Codes:
    """Learned codes: ``mean`` and ``axes`` (dimensions + 1 x bits), the ``longest`` vector's length and the search ``radius``."""

    mean: np.ndarray
    axes: np.ndarray
    longest: float
    radius: int = 0

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes of rows, as bytes."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        size = np.sqrt((x * x).sum(axis=1)) if query else np.full(len(x), self.longest)
        unit = np.column_stack([x, more]) / np.maximum(size, 1e-300)[:, None]
        return np.packbits((unit - self.mean) @ self.axes > 0, axis=1)


def learn(sample: np.ndarray, longest: float, bits: int = 128, iterations: int = 30, seed: int = 1) -> Codes:
    """Rotations of the principal axes of the sample, each fitted by iterative quantization, side by side until there are ``bits`` bits."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample * sample).sum(axis=1), 0))]) / longest
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    axes = []
    while sum(a.shape[1] for a in axes) < bits:
        width = min(len(vt), bits - sum(a.shape[1] for a in axes), sample.shape[1])
        v = (x - mean) @ vt[:width].T
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(iterations):
            u, _, wt = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        axes.append(vt[:width].T @ r)
    return Codes(mean, np.concatenate(axes, axis=1), longest)


def _hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ query.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def calibrate(codes: Codes, sample: np.ndarray, k: float, recall: float, queries: int = 400) -> Codes:
    """The radius that holds ``recall`` of the ``k`` true neighbours of sample queries, k being a neighbour's rank scaled to the sample's size; below one, the nearest counts."""
    q = sample[:queries]
    close = q @ sample.T
    close[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-close, axis=1)[:, : max(1, min(int(np.ceil(k)), len(sample) - 1))]
    mine, theirs = codes.encode(q, True), codes.encode(sample, False)
    d = np.concatenate([_hamming(theirs[n], c[None, :]) for n, c in zip(near, mine, strict=True)])
    return Codes(codes.mean, codes.axes, codes.longest, int(np.quantile(d, recall, method="higher")))


class Index:
    """The substring index of a block of rows with distinct ids."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray, tails: dict[int, np.ndarray] | None = None):
        self.codes, self.ids, self.x, self.tails = codes, ids, x, tails or {}
        self.code = codes.encode(x, False)
        self.tables: dict[int, list[tuple[int, np.ndarray]]] = {}

    def entries(self, radius: int) -> list[tuple[int, np.ndarray]]:
        """(substring, bitmaps by value) of the rows whose substring has as few errors as the pigeonhole principle asks for."""
        if radius not in self.tables:
            m, found = self.code.shape[1], []
            for s in range(m):
                reach = radius // m - (s > radius % m)
                if reach >= 0:
                    found.append((s, np.stack([np.packbits(_DISTANCE[v][self.code[:, s]] <= reach) for v in range(256)])))
            self.tables = {self.codes.radius: self.tables.get(self.codes.radius, []), radius: found}
        return self.tables[radius]

    def probe(self, codes: np.ndarray, radius: int) -> np.ndarray:
        """(queries x rows): which rows the probes of each code reach."""
        hit = np.zeros((len(codes), -(-len(self.ids) // 8)), dtype=np.uint8)
        for s, table in self.entries(radius):
            hit |= table[codes[:, s]]
        return np.unpackbits(hit, axis=1, count=len(self.ids)).astype(bool)

    def within(self, codes: np.ndarray, radius: int) -> list[np.ndarray]:
        """For each code all rows whose code lies within the radius, by probing."""
        out = []
        for code, hit in zip(codes, self.probe(codes, radius), strict=True):
            found = np.flatnonzero(hit)
            out.append(found[_hamming(self.code[found], code[None, :]) <= radius])
        return out

    def search(self, ids: np.ndarray, q: np.ndarray, codes: np.ndarray, k: int, tails: dict[int, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the (ids, scores) of the k best rows among those within the radius, ties to smaller ids; the query's own id is left out."""
        for a in range(0, len(ids), 256):
            for n, at in enumerate(self.within(codes[a : a + 256], self.codes.radius), a):
                radius, bits = self.codes.radius, 8 * codes.shape[1]
                while (mine := at[self.ids[at] != ids[n]]).size < k and radius < bits:
                    radius = min(bits, radius + max(1, bits // 32))
                    at = self.within(codes[n : n + 1], radius)[0]
                yield self._rank(mine, q[n], k, (tails or {}).get(n))

    def _rank(self, at: np.ndarray, q: np.ndarray, k: int, tail: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rows, score = self.x[at], np.zeros(len(at))
        for d in range(rows.shape[1]):  # in the order of components: equal vectors score equally wherever they lie
            score += rows[:, d] * q[d]
        if tail is not None and self.tails:
            for i, row in enumerate(at):
                for a, b in zip(self.tails.get(int(row), ()), tail, strict=False):
                    score[i] += a * b
        if len(at) > k:
            at, score = at[keep := score >= np.partition(score, -k)[-k]], score[keep]
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[order]], score[order]


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The first ``dims`` components of every row, missing ones 0, and the further ones of rows that have more."""
    if not len(column):
        return np.zeros((0, dims)), {}
    flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if (np.diff(off) == dims).all():
        return flat[off[0] : off[-1]].reshape(-1, dims), {}
    out, tails = np.zeros((len(column), dims)), {}
    for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        out[i, : min(b - a, dims)] = flat[a : min(b, a + dims)]
        if b - a > dims:
            tails[i] = flat[a + dims : b]
    return out, tails


def _answer(codes, k: int, dims: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        c = codes.value
        out = [[], [], []]
        if rows.num_rows and queries.num_rows:
            col = lambda t, name: _matrix(t.column(name).combine_chunks(), dims)
            index = Index(c, rows.column("id").to_numpy(), *col(rows, "x"))
            ids, (q, tails) = queries.column("id").to_numpy(), col(queries, "x")
            for i, (found, score) in zip(ids, index.search(ids, q, c.encode(q, True), k, tails), strict=True):
                out[0].append(np.full(len(found), i))
                out[1].append(found)
                out[2].append(score)
        return pa.Table.from_arrays([pa.array(np.concatenate(o) if o else [], type=f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, bits: int = 256, recall: float = 0.97, sample_rows: int = 4000, block: int = 16384, block_bytes: int = 64 << 20) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by ``every``; each gets its
    ``k`` best of all other rows by inner product. Rows that are null, empty,
    zero, or hold null or non-finite components take no part, nor do rows
    without vec_id. Rows that share a vec_id are one vector, the smallest as an
    array, so every query has one answer and names a neighbour once. Vectors of
    different lengths are multiplied over the components that both have; codes
    are made of as many components as most vectors have. Fitted on the
    ``sample_rows`` rows with the smallest hash of vec_id; every row is indexed,
    in blocks of ``block`` rows and ``block_bytes`` at most. No vectors give no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).where(F.exists("x", lambda v: v != 0))
    rows = materialize(rows.groupBy("id").agg(F.min("x").alias("x")), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("longest"))
    widths = widths.agg(F.max(F.struct("n", -F.col("dims"))).alias("most"), F.sum("n").alias("n"), F.max("longest").alias("longest")).select((-F.col("most.col2")).alias("dims"), "n", "longest").first()
    if widths["n"] is None:
        return empty
    dims, n = widths["dims"], widths["n"]
    share = min(1.0, (sample_rows + 3 * sample_rows**0.5 + 10) / n)  # little more than is wanted leaves the tasks
    some = rows.where((F.size("x") == dims) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("x")
    sample = np.array([r["x"] for r in some.collect()]).reshape(-1, dims)  # bounded by sample_rows
    codes = learn(sample, widths["longest"], bits)
    codes = calibrate(codes, sample, k * len(sample) / n, recall) if len(sample) else codes
    block = max(256, min(block, block_bytes // (8 * dims)))
    blocks, asked = max(1, -(-n // block)), rows.where(F.col("id") % every == 0)
    parts = max(1, -(-n // (every * block)))
    data = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "id", "x")
    wanted = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).cast("int").alias("p"), "id", "x")
    found = data.groupBy("b", "p").cogroup(wanted.groupBy("b", "p")).applyInArrow(_answer(spark.sparkContext.broadcast(codes), k, dims), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
