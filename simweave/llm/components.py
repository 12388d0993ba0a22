"""Connected components of an edge table, without gathering any of it on one machine.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each is one minimum per node with map-side
combination and one join, and the number of steps grows with the logarithm of
the longest path. Every step is written to the shared folder, so that lost
executors cost a step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.scratch import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``edges`` (u, v) -> (id, component) for every node with an edge; a component's name is its smallest id.

    Self-loops and repeated edges are allowed, rows with a null end are left
    out, and no edges give an empty table.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(max_steps):
        new = materialize(_small_star(_large_star(now)).where("u <> v").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
