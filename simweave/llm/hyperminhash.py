"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles. A register keeps the smallest
hash that a bucket saw, compressed to its leading-zero count and ten mantissa
bits (Yu and Weber, "HyperMinHash: MinHash in LogLog space"). Sets of
``SPLIT`` shingles or more deal their shingles out to the buckets
(k-partition); smaller sets show every bucket all shingles (k-mins), as most
buckets would be empty otherwise. Sets between SPLIT and SPLIT / threshold get
both, so two sets that can be linked always share a scheme.

Bands of ``ROWS`` registers are hashed; documents that agree in one are
candidates. At 0.8, 56 bands of six registers miss a pair with probability
4e-8. Then

1. equal sets are one node, named by its smallest doc_id;
2. in a few rounds, every document is tried with one center of another
   component, that of its buckets which it shares most often: linear in the
   documents. The collision-corrected Jaccard estimate drops what lies five
   standard deviations below the threshold, the full shingle sets confirm the
   rest, and confirmed links give components;
3. buckets that still hold several components are searched for links between
   *different* components: in small buckets by the estimate from the registers,
   in large ones (over ``LARGE`` members) by counting shared shingle
   fingerprints in tiles of bounded members and bytes, so that what leaves a
   task are links and not the many pairs just below the threshold. They are
   confirmed as before. Groups of copies are one component by then: a bucket's
   largest component does not meet itself.

Step 3 makes the components those of all links, whatever step 2 tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.llm import textkit as tk
from simweave.llm.components import components
from simweave.llm.sifting import semi_join
from simweave.scratch import discard, materialize

BANDS, ROWS, MANTISSA = 56, 6, 10
REGISTERS = BANDS * ROWS
SPLIT = 3 * REGISTERS
TILE = 2048
#: Bytes of fingerprints in half a tile.
HALF_BYTES = 8 << 20
STAR_ROUNDS = 2
LARGE = 32
EMPTY = 0xFFFF

_rng = np.random.default_rng(8)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def compress(v: np.ndarray) -> np.ndarray:
    """Leading zeros and the next mantissa bits of 32-bit values, as one 16-bit register."""
    exponent = np.frexp(v.astype(np.float64))[1].astype(np.int64)  # 0 for 0
    v64 = v.astype(np.uint64)
    mantissa = ((v64 << np.uint64(MANTISSA)) >> np.maximum(exponent - 1, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((32 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def registers(s: np.ndarray, partitioned: bool) -> np.ndarray:
    """The REGISTERS registers of a set of 64-bit shingle hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    if not partitioned:
        least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
        for k in range(0, len(x), 2048):
            np.minimum(least, (x[k : k + 2048, None] * _MUL + _ADD).min(axis=0), out=least)
        return compress(least)
    bucket = ((s & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)
    order = np.argsort(x)[::-1]
    least = np.zeros(REGISTERS, dtype=np.uint32)
    seen = np.zeros(REGISTERS, dtype=bool)
    least[bucket[order]] = x[order]  # the smallest is written last
    seen[bucket] = True
    return np.where(seen, compress(least), np.uint16(EMPTY))


def _sketch(threshold: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in tk.slices(b, 1)):
            ids = batch.column(0).to_pylist()
            hashes, off = tk.words(batch.column(1))
            rows: list[tuple] = []
            for i, s in enumerate(tk.shingles(hashes, off, shingle)):
                with np.errstate(over="ignore"):
                    k1 = int(s.sum(dtype=np.uint64)) if len(s) else 0
                    k2 = int(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0
                schemes = [p for p, ok in ((False, 0 < len(s) and len(s) * threshold <= SPLIT), (True, len(s) >= SPLIT)) if ok]
                for first, p in enumerate(schemes or [None]):
                    rows.append((ids[i], len(s), k1 - (1 << 63), k2 - (1 << 63), p, first == 0, registers(s, p).tobytes() if p is not None else None))
                if len(rows) >= 2000:
                    yield _batch(rows, SKETCH)
                    rows = []
            yield _batch(rows, SKETCH)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.bool_()), ("first", pa.bool_()), ("regs", pa.binary())])
SKETCH_DDL = "doc_id long, n_shingles long, k1 long, k2 long, part boolean, first boolean, regs binary"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, regs) -> (key, id, part, band), one row a band that is not all empty."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            m = _matrix(part.column(2)).reshape(-1, BANDS, ROWS)
            scheme = part.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(1 << 20) + scheme[:, None].astype(np.uint64)
                key = tk.mix(key)
                for r in range(ROWS):
                    key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r].astype(np.uint64))
            keep = ~(m == EMPTY).all(axis=2)
            ids = np.broadcast_to(part.column(0).to_numpy()[:, None], key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(ids[keep]), pa.array(np.broadcast_to(scheme[:, None], key.shape)[keep]), pa.array(np.broadcast_to(np.arange(BANDS, dtype=np.int32), key.shape)[keep])], names=["key", "id", "part", "band"])


def _same_zeros(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that the least of n and the least of m uniforms have equally many leading zeros."""
    p = np.zeros(np.broadcast(n, m).shape)
    for k in range(32):
        hi, lo = 2.0**-k, 2.0 ** -(k + 1)
        p += ((1 - lo) ** n - (1 - hi) ** n) * ((1 - lo) ** m - (1 - hi) ** m)
    return p


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of registers that tell."""
    both = (a != EMPTY) | (b != EMPTY)
    told = both.sum(axis=-1)
    same = ((a == b) & both).sum(axis=-1)
    share = np.where(part, REGISTERS, 1)
    chance = _same_zeros(np.maximum(n / share, 1), np.maximum(m / share, 1)) / (1 << MANTISSA)
    return (same / np.maximum(told, 1) - chance) / (1 - chance), told


def _likely(threshold: float, j: np.ndarray, told: np.ndarray) -> np.ndarray:
    return j >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(told, 1))


def _keep_likely(threshold: float):
    """(a, b, part, na, ra, nb, rb) -> (a, b) where the estimate does not exclude a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                x = batch.slice(k, 4000)
                j, told = estimate(_matrix(x.column(4)), _matrix(x.column(6)), x.column(3).to_numpy(), x.column(5).to_numpy(), x.column(2).to_numpy(zero_copy_only=False))
                yield x.select([0, 1]).filter(pa.array(_likely(threshold, j, told)))

    return run


def _tile_search(threshold: float):
    """Rows (key, ta, tb, side, id, comp, n, band, part, regs), sorted by the first three -> likely links (a, b) between components.

    A run of rows with one (key, ta, tb) is a bucket of LARGE members at most. A
    link comes out of the first band that its two sides share, hence once a scheme.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(run: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in run if r[3] == s] for s in (0, 1)]
        if not sides[0]:
            return []
        one = not sides[1]
        a, b = sides[0], sides[0] if one else sides[1]
        ids, comps, ns = ([np.array([r[k] for r in s]) for s in (a, b)] for k in (4, 5, 6))
        regs = [np.frombuffer(b"".join(r[9] for r in s), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b)]
        out = []
        for i in range(len(a)):
            at = np.flatnonzero((comps[1] != comps[0][i]) & (np.minimum(ns[1], ns[0][i]) >= threshold * np.maximum(ns[1], ns[0][i])))
            at = at[at > i] if one else at
            if len(at):
                mine = regs[0][i][None, :]
                j, told = estimate(mine, regs[1][at], ns[0][i], ns[1][at], np.array(a[i][8]))
                at = at[_likely(threshold, j, told)]
                agree = ((mine == regs[1][at]).reshape(len(at), BANDS, ROWS)).all(axis=2) & ~(mine.reshape(BANDS, ROWS) == EMPTY).all(axis=1)
                out += [(int(ids[0][i]), int(x)) for x in ids[1][at[agree.argmax(axis=1) == a[i][7]]]]
        return out

    return _by_runs(search, schema)


def _tile_compare(threshold: float):
    """Rows (key, ta, tb, side, id, comp, n, s), sorted by the first three -> likely links (a, b) between components.

    ``s`` holds the upper halves of the shingle hashes. Shared ones are counted
    for each row that is not of the run's commonest component, against all
    others at once.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(run: list[tuple]) -> list[tuple[int, int]]:
        ids, comps, ns, side = (np.array([r[k] for r in run]) for k in (4, 5, 6, 3))
        two = side.any()
        sets = [np.frombuffer(r[7], dtype=np.uint32) for r in run]
        flat, where = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.cumsum([0] + [len(x) for x in sets])
        names, times = np.unique(comps, return_counts=True)
        common = names[times.argmax()]
        mark = np.zeros(len(flat), dtype=np.int32)
        out = []
        for i in np.flatnonzero(comps != common):
            mine = where[bounds[i] : bounds[i + 1]]
            mark[mine] = 1
            shared = np.add.reduceat(mark[where], bounds[:-1])
            mark[mine] = 0
            # upper halves may coincide by chance, hence the margin
            ok = (shared >= (threshold - 0.01) * (ns + ns[i] - shared)) & (comps != comps[i])
            if two:
                ok &= side != side[i]
            out += [(int(ids[i]), int(x)) for x in ids[ok]]
        return out

    return _by_runs(search, schema)


def _by_runs(search, schema: pa.Schema):
    """Apply ``search`` to every run of rows that agree in their first three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += search(held)
                    held = []
                held.append(row)
            yield _batch(out, schema)
        if held:
            yield _batch(search(held), schema)

    return run


def _sets(shingle: int, halves: bool = False):
    """(id, text) -> (id, s): the sorted shingle hashes, or their upper halves, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in tk.slices(b, 1)):
            hashes, off = tk.words(batch.column(1))
            s = [((x >> np.uint64(32)).astype(np.uint32) if halves else x).tobytes() for x in tk.shingles(hashes, off, shingle)]
            for k in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 500), pa.array(s[k : k + 500], type=pa.binary())], names=["id", "s"])

    return run


def _confirm(threshold: float):
    """(a, b, sa, sb) -> (u, v) with a Jaccard similarity of at least the threshold, counted in hundredths as integers."""
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (sa, sb))
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= hundredths * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, type=pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return semi_join(docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), ids.select("id"), "id")


def links(docs: DataFrame, pairs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets confirm the link, as (u, v)."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_texts_of(docs, ends).mapInArrow(tk.tidy(_sets(shingle)), "id long, s binary"), "sets")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    found = materialize(full.mapInArrow(tk.tidy(_confirm(threshold)), "u long, v long").distinct(), "links")
    discard(sets)
    return found


def _mixed(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several components: also ``comp``, the bucket's smallest (comp, id) as ``center``, and its ``size``."""
    named = members.withColumn("comp", F.col("id")) if known is None else members.join(known, "id", "left").select(*members.columns, F.coalesce("component", "id").alias("comp"))
    groups = named.groupBy("key", "part").agg(F.min(F.struct("comp", "id")).alias("center"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("center.comp < hi").drop("hi")
    return named.join(groups, ["key", "part"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for each of its rows.

    Linked are documents with 100 * intersection >= 100 * threshold * union of
    their shingle sets. A null or blank text has the empty set and no links. A
    row without doc_id keeps no name: its component_id is null and it is kept.
    Rows that share a doc_id are one document. Other columns are ignored.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the bands are laid out for thresholds from 0.5 to 1")
    sketch = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tk.tidy(_sketch(threshold, shingle)), SKETCH_DDL), "sketch")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    used = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(used.groupBy("k1", "k2", "part").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "reps")
    keys = reps.select("id", "part", "regs").mapInArrow(tk.tidy(_band_keys), "key long, id long, part boolean, band int")
    shared = keys.groupBy("key", "part").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    members = materialize(keys.join(shared.select("key", "part"), ["key", "part"]), "members")
    # most documents share no bucket, and their registers are not needed any more
    busy = materialize(semi_join(reps, members.select("id"), "id"), "busy")
    found, known = _star_rounds(docs, members, busy, threshold, shingle)
    more = _search_rest(docs, members, busy, known, threshold, shingle)
    if not more.isEmpty():
        known = materialize(components(found.unionAll(more)), "components")
    discard(members, busy)
    final = known

    node = reps.select("k1", "k2", "id").distinct().join(final, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    rows = sketch.where("first").select("doc_id", "n_shingles", "k1", "k2")
    named = rows.where("doc_id is not null and n_shingles > 0").join(node, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _star_rounds(docs: DataFrame, members: DataFrame, reps: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Links found by trying, in each round, one pair a document: with the center, of another component, that it shares most buckets with."""
    side = lambda s: reps.select(F.col("id").alias(s), "part", F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    found = known = tried = None
    for _ in range(STAR_ROUNDS):
        ties = _mixed(members, known).where("comp <> center.comp").groupBy("id", "part", F.col("center.id").alias("a")).agg(F.count("*").alias("shared"))
        if tried is not None:
            ties = ties.join(tried, ["a", "id"], "left_anti")
        best = materialize(ties.groupBy("id").agg(F.max(F.struct("shared", -F.col("a"), "part")).alias("m")).select((-F.col("m.col2")).alias("a"), "id", F.col("m.part").alias("part")), "stars")
        likely = best.withColumnRenamed("id", "b").join(side("a"), ["a", "part"]).join(side("b"), ["b", "part"]).select("a", "b", "part", "na", "ra", "nb", "rb")
        pairs = materialize(likely.mapInArrow(tk.tidy(_keep_likely(threshold)), "a long, b long").distinct(), "pairs")
        new = links(docs, pairs, threshold, shingle)
        discard(pairs)
        tried = best.select("a", "id") if tried is None else tried.unionAll(best.select("a", "id"))
        if known is not None and new.isEmpty():
            break
        found = new if found is None else found.unionAll(new)
        known = materialize(components(found), "components")
    return found, known


def _tiles(members: DataFrame, half: int | None = None, half_bytes: int = HALF_BYTES) -> DataFrame:
    """Members (key, part, id, comp, n, band) of buckets as rows of tiles (key, ta, tb, side, ...), such that two members of different components meet in one tile.

    A bucket's largest component need not meet itself: its members lie in tiles
    of their own, and each meets the tiles of the others only. So a bucket in
    which most belong to one component is copied a few times however large it
    is. Half a tile holds about ``half`` members and ``half_bytes`` of fingerprints.
    """
    half = half or TILE // 2
    sizes = members.groupBy("key", "part", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    rows, size = lambda m: F.coalesce(F.sum(m), F.lit(0)), F.col("s") * 4
    # the largest component, ties to the smallest name
    main = sizes.groupBy("key", "part").agg(F.max(F.struct("m", -F.col("comp"))).alias("top"), F.sum("m").alias("members"), F.sum(size).alias("bytes"))
    main = main.join(sizes.select("key", "part", F.col("comp").alias("main"), F.col("m").alias("mm"), size.alias("mb")), ["key", "part"]).where("main = -top.col2")
    tiles = lambda m, b: F.greatest(F.ceil(m / half), F.ceil(b / half_bytes), F.lit(1)).cast("int")
    grid = main.select("key", "part", "main", tiles(F.col("mm"), F.col("mb")).alias("mt"), tiles(F.col("members") - F.col("mm"), F.col("bytes") - F.col("mb")).alias("ot"))
    placed = members.join(grid, ["key", "part"]).withColumn("is_main", F.col("comp") == F.col("main"))
    # tiles 0 to ot - 1 hold the others, the next mt the largest component
    placed = placed.withColumn("tile", F.when(F.col("is_main"), F.col("ot") + F.pmod(F.xxhash64("id"), F.col("mt"))).otherwise(F.pmod(F.xxhash64("id"), F.col("ot"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("ot") - 1).otherwise(F.col("ot") + F.col("mt") - 1))
    return placed.withColumn("other", F.explode(meets)).select("key", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side"), "id", "comp", "n", "part", "band")


def _search_rest(docs: DataFrame, members: DataFrame, reps: DataFrame, known: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """All links between different components of ``known``."""
    mixed = materialize(_mixed(members, known).join(reps.select("id", "part", "n"), ["id", "part"]), "mixed")
    place = lambda df: df.repartition(F.col("key"), F.col("ta"), F.col("tb")).sortWithinPartitions("key", "ta", "tb")
    # a small bucket is one tile
    few = mixed.where(F.col("size") <= LARGE).join(reps.select("id", "part", "regs"), ["id", "part"]).withColumns({"ta": F.lit(0), "tb": F.lit(0), "side": F.lit(0)})
    some = place(few.select("key", "ta", "tb", "side", "id", "comp", "n", "band", "part", "regs")).mapInArrow(tk.tidy(_tile_search(threshold)), "a long, b long")
    large = mixed.where(F.col("size") > LARGE)
    halves = materialize(_texts_of(docs, large.select("id").distinct()).mapInArrow(tk.tidy(_sets(shingle, True)), "id long, s binary"), "halves")
    many = _tiles(large).join(halves, "id")
    more = place(many.select("key", "ta", "tb", "side", "id", "comp", "n", "s")).mapInArrow(tk.tidy(_tile_compare(threshold)), "a long, b long")
    pairs = materialize(some.unionAll(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = links(docs, pairs, threshold, shingle)
    discard(mixed, halves, pairs)
    return found
