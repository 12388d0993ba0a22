"""Cosine similarity of all pairs of units of one type.

The default plan deals the vectors of a type into tiles, gives every pair of
tiles to one task and multiplies them there as matrices; only pairs that reach
the threshold leave the task, with what the caller wants of both sides. Tiles,
not types, are the unit of work, so a type with most of the units is still many
tasks; they lie in the shared folder once. ``cosine`` is the same measure as a
column expression, for joins that already have few candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simweave.operators.tiles import ROWS, meet

TILE = 4096
#: Rows of a tile that are multiplied at once.
SLICE = 512


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; the shorter vector counts as padded with zeros."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """Rows of length one, padded with zeros; null components are 0."""
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    sizes, off = np.diff(off), off - off[0]
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - off[:-1][row]] = flat
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


#: Makes a batch of pairs: the rows of both tiles, the places of the left and of the right sides in them, their type, similarities.
Form = Callable[[pa.Table, np.ndarray, np.ndarray, str, np.ndarray], pa.RecordBatch]


def sides(carry: tuple[str, ...]) -> Form:
    def form(rows: pa.Table, left: np.ndarray, right: np.ndarray, kind: str, s: np.ndarray) -> pa.RecordBatch:
        of = lambda c, at: rows.column(c).chunk(0).take(pa.array(at))
        both = {f"{side}_{c}": of(c, at) for c in carry for side, at in (("left", left), ("right", right))}
        return pa.RecordBatch.from_pydict({"left_id": of("id", left), "right_id": of("id", right), "unit_type": pa.repeat(pa.scalar(kind, pa.string()), len(left)), "similarity": pa.array(s)} | both)

    return form


def stacked(a: pa.Table, b: pa.Table | None) -> tuple[pa.Table, np.ndarray, int]:
    """The rows of both tiles in one table, the rank of each row's id, and where the second tile begins (0: there is one)."""
    rows = a if b is None else pa.concat_tables([a, b]).combine_chunks()
    rank = pc.rank(rows.column("id"), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    return rows, rank, 0 if b is None else a.num_rows


def in_order(rank: np.ndarray, i: np.ndarray, j: np.ndarray, one_tile: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left sides, right sides, and which pairs count: both orders of a pair are found within one tile, one across tiles."""
    x, y = rank[i], rank[j]
    return (i, j, x < y) if one_tile else (np.where(x > y, j, i), np.where(x > y, i, j), x != y)


def _multiply(thresholds: float | dict[str, float], form: Form):
    def run(a: pa.Table, b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        rows, rank, second = stacked(a, b)
        kind = rows.column("unit_type")[0].as_py()
        threshold = thresholds[kind] if isinstance(thresholds, dict) else thresholds
        touched = rows.column("dirty").to_numpy()
        x = unit_rows(rows.column("embedding").combine_chunks())
        for k in range(0, a.num_rows, SLICE):
            s = x[k : min(k + SLICE, a.num_rows)] @ x[second:].T
            i, j = np.nonzero(s >= threshold)
            left, right, keep = in_order(rank, i + k, j + second, b is None)
            keep &= touched[left] | touched[right]
            left, right, near = left[keep], right[keep], s[i[keep], j[keep]]
            for n in range(0, len(left), ROWS):
                part = slice(n, n + ROWS)
                yield form(rows, left[part], right[part], kind, near[part])

    return run


def marked(units: DataFrame, dirty: DataFrame | None, *columns: str) -> DataFrame:
    """The units with a vector, and whether they are among ``dirty`` (none given: all are)."""
    rows = units.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0).select("id", "unit_type", "embedding", *columns)
    if dirty is None:
        return rows.withColumn("dirty", F.lit(True))
    return rows.join(dirty.select("id").distinct().withColumn("dirty", F.lit(True)), "id", "left").fillna(False, ["dirty"])


def similar_pairs(units: DataFrame, threshold: float | dict[str, float], dirty: DataFrame | None = None, tile: int = TILE, carry: tuple[str, ...] = (), form: Callable[[Form], Form] | None = None, adds: str | None = None, keep: tuple[str, ...] | None = None, size: Column | None = None) -> DataFrame:
    """``units`` (id, unit_type, embedding) -> (left_id, right_id, unit_type, similarity) with left_id < right_id.

    The threshold is one for all or one for each type. Units without a vector
    take no part; ids are unique. With ``dirty`` (id),
    only pairs with a dirty side are formed, and tiles without any are not
    multiplied with each other. A vector of length zero has similarity 0.
    Columns in ``carry`` leave with the pairs as left_ and right_, so that no
    pair has to look up its sides. ``form`` wraps what makes the batches, to add
    the column ``adds`` (a string) from all carried ones while the pairs keep
    only ``keep`` of them. ``size``: see :func:`meet`.
    """
    rows = marked(units, dirty, *carry)
    kept = carry if keep is None else keep
    kinds = {f.name: f.dataType for f in rows.schema}
    found = StructType().add("left_id", "string").add("right_id", "string").add("unit_type", "string").add("similarity", "double")
    for c in kept:
        found = found.add(f"left_{c}", kinds[c]).add(f"right_{c}", kinds[c])
    make = sides(kept)
    if form is not None and adds is not None:
        make, found = form(make), found.add(adds, "string")
    return meet(rows, F.col("id"), _multiply(threshold, make), found, tile, size)


#: Vectors up to this long are columns of a join, longer ones stay arrays.
WIDE = 200


def similar_pairs_by_expression(units: DataFrame, threshold: float | dict[str, float], dirty: DataFrame | None = None, tile: int = 1024) -> DataFrame:
    """The same pairs as a join with a column expression, without Python: tiles meet on their pair of numbers, so a type is many keys.

    Components are columns, so the product of a pair is compiled arithmetic; functions on arrays are interpreted, component by component.
    """
    rows = units.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0).select("id", "unit_type", "embedding", norm(F.col("embedding")).alias("size"))
    # a row a type
    sizes = rows.groupBy("unit_type").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    parts = [F.coalesce(F.get("embedding", F.lit(k)).cast("double"), F.lit(0.0)).alias(f"e{k}") for k in range(width)] if width <= WIDE else [F.col("embedding")]
    names = ["id", "size", *([f"e{k}" for k in range(width)] if width <= WIDE else ["embedding"])]
    placed = rows.join(F.broadcast(sizes), "unit_type").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("unit_type", "tile", "other", "id", "size", *parts)
    cell = [F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb")]
    # each side once: a tile meets itself on both sides, others on the lower number's left
    side = lambda rows, s: rows.select("unit_type", *cell, *[F.col(c).alias(f"{s}_{c}") for c in names])
    a, b = side(placed.where("tile <= other"), "a"), side(placed.where("tile >= other"), "b")
    both = F.col("a_size") * F.col("b_size")
    product = reduce(add, [F.col(f"a_e{k}") * F.col(f"b_e{k}") for k in range(width)], F.lit(0.0)) if width <= WIDE else dot(F.col("a_embedding"), F.col("b_embedding"))
    s = F.when(both == 0, F.lit(0.0)).otherwise(product / both)
    kind = F.col("unit_type")
    least = F.lit(threshold) if not isinstance(threshold, dict) else F.coalesce(*[F.when(kind == k, F.lit(t)) for k, t in threshold.items()])
    met = a.join(b, ["unit_type", "ta", "tb"]).where("a_id < b_id or (a_id > b_id and ta < tb)")
    found = met.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "unit_type", s.alias("similarity")).where(F.col("similarity") >= least)
    if dirty is None:
        return found
    mark = lambda c: dirty.select(F.col("id").alias(c)).distinct().withColumn(f"_{c}", F.lit(True))
    return found.join(mark("left_id"), "left_id", "left").join(mark("right_id"), "right_id", "left").where(F.coalesce("_left_id", "_right_id").isNotNull()).select("left_id", "right_id", "unit_type", "similarity")
