"""Rows dealt into tiles that are written once, and tasks that read two of them.

Pairs of tiles are a small table of names. A task reads the tiles that its rows
name from the shared scratch folder and gives them to a function of its own, so
what lies on disk is in proportion to the rows, and nothing leaves a task except
what that function keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simweave.scratch import materialize, scratch_path, small_batches
from simweave.sources.fs import open_fs

#: Tasks of one search at most; each takes several pairs of tiles then.
TASKS = 2000
#: Rows that leave at once.
ROWS = 32768

#: Gets the rows of one type in two tiles, or in one (None), and yields what it keeps.
Work = Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]]


def _read(fs: pafs.FileSystem, folder: str) -> pa.Table | None:
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("part-"))
    parts = []
    for name in names:
        with fs.open_input_file(name) as f:
            parts.append(pq.ParquetFile(f).read())
    return pa.concat_tables(parts).combine_chunks() if parts else None


def _by_type(a: pa.Table, b: pa.Table | None) -> Iterator[tuple[pa.Table, pa.Table | None]]:
    """Small types share tiles; others have tiles of their own."""
    kinds = [set(x.column("unit_type").unique().to_pylist()) for x in (a, b) if x is not None]
    if all(len(k) == 1 for k in kinds):
        if kinds[0] == kinds[-1]:
            yield a, b
        return
    of = lambda x, kind: x.filter(pc.equal(x.column("unit_type"), kind)).combine_chunks()
    for kind in sorted(kinds[0] & kinds[-1]):
        yield of(a, kind), None if b is None else of(b, kind)


def _visit(root: str, work: Work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        known: dict[str, pa.Table | None] = {}
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {k: known[k] if k in known else _read(fs, f"{base}/key={k}") for k in (a, b)}
                if known[a] is None or known[b] is None:  # no row fell there
                    continue
                for left, right in _by_type(known[a], None if a == b else known[b]):
                    yield from work(left, right)

    return run


def meet(rows: DataFrame, by: Column, work: Work, schema: str | StructType, tile: int, size: Column | None = None) -> DataFrame:
    """What ``work`` makes of all pairs of tiles of one type that hold a dirty row.

    ``rows`` (unit_type, dirty, ...) are dealt by the hash of ``by``; dirty and
    clean rows of a type lie in different tiles, types of one tile at most share
    tiles. Rows without a type take no part. A tile has rows of about ``tile``
    in all, each of 1 or of ``size``.
    """
    size = F.lit(1) if size is None else size
    sizes = rows.where(F.col("unit_type").isNotNull()).groupBy("unit_type").agg(F.sum(F.when(F.col("dirty"), size).otherwise(0)).alias("d"), F.sum(F.when(F.col("dirty"), 0).otherwise(size)).alias("c"))
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    small = F.col("d") + F.col("c") <= tile
    sizes = sizes.where("d > 0").select("unit_type", "d", "c", tiles("d").alias("nd"), tiles("c").alias("nc"), small.alias("small"))
    together = sizes.agg(F.coalesce(F.ceil(F.sum(F.when(F.col("small"), F.col("d") + F.col("c"))) / tile), F.lit(1)).cast("int").alias("shared"))
    # a row a type
    grid = materialize(sizes.crossJoin(F.broadcast(together)), "grid")
    kind = F.xxhash64("unit_type")
    apart = lambda k: F.concat(F.hex(kind), F.lit("_"), F.col(k).cast("string"))
    shared = F.concat(F.lit("s_"), F.pmod(kind, F.col("shared")).cast("string"))
    place = F.when(F.col("dirty"), F.pmod(F.xxhash64(by), F.col("nd"))).otherwise(F.col("nd") + F.pmod(F.xxhash64(by), F.greatest("nc", F.lit(1))))
    placed = rows.join(F.broadcast(grid), "unit_type").withColumn("_place", place).withColumn("key", F.when(F.col("small"), shared).otherwise(apart("_place")))
    root = scratch_path(rows.sparkSession, "tiles")
    with small_batches(rows.sparkSession):
        placed.select(*rows.columns, "key").repartition("key").write.partitionBy("key").parquet(root)
    large = grid.where(~F.col("small")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("nd") - 1))).withColumn("_b", F.explode(F.sequence(F.col("_a"), F.col("nd") + F.col("nc") - 1)))
    cells = large.select(apart("_a").alias("a"), apart("_b").alias("b")).unionAll(grid.where("small").select(shared.alias("a"), shared.alias("b"))).distinct()
    return cells.repartition(min(TASKS, max(1, cells.count()))).mapInArrow(_visit(root, work), schema)
