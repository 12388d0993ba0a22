"""Snapshot differences, reuse of earlier results, upserts and deletions as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.functions.labels import id_key


def snapshot_diff(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """``current`` and ``tracked`` (file_path, checksum, mtime) -> (file_path, status): added, deleted, changed or unchanged.

    An equal mtime means unchanged whatever the checksum; else checksums decide.
    """
    c = current.select("file_path", F.col("checksum").alias("c_sum"), F.col("mtime").alias("c_time"), F.lit(True).alias("here"))
    t = tracked.select("file_path", F.col("checksum").alias("t_sum"), F.col("mtime").alias("t_time"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("c_time") == F.col("t_time"), "unchanged").when(F.col("c_sum") == F.col("t_sum"), "unchanged").otherwise("changed")
    return c.join(t, "file_path", "full_outer").select("file_path", status.alias("status"))


def dirty_paths(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status") != "unchanged").select("file_path")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_by(rows: DataFrame, gone: DataFrame, column: str, key: str = "file_path") -> DataFrame:
    """Without the rows whose ``column`` is among ``gone``'s keys; null stays."""
    return rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def delete_by_either(rows: DataFrame, gone: DataFrame, left: str, right: str, key: str = "file_path") -> DataFrame:
    """Two anti-joins: a disjunction in one join would be a nested loop."""
    return delete_by(delete_by(rows, gone, left, key), gone, right, key)


def reusable_pairs(previous: DataFrame, units: DataFrame, dirty: DataFrame) -> DataFrame:
    """Earlier pairs (left_id, right_id, left_file, right_file, ...) whose sides are both still there and both clean."""
    clean = delete_by_either(previous, dirty, "left_file", "right_file")
    for side in ("left_id", "right_id"):
        clean = clean.join(units.select(F.col("id").alias(side)), side, "left_semi")
    return clean.select(*previous.columns)


def merge_pairs(reused: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Both, the recomputed one where they agree in their unordered ids."""
    key = id_key(F.col("left_id"), F.col("right_id"))
    a, b = reused.withColumn("pair", key), recomputed.withColumn("pair", key)
    return a.join(b.select("pair"), "pair", "left_anti").unionByName(b).drop("pair")


def touches_dirty(pairs: DataFrame, dirty: DataFrame, left: str = "left_file", right: str = "right_file") -> DataFrame:
    """Pairs with a dirty file on either side."""
    mark = lambda s: dirty.select(F.col("file_path").alias(s)).distinct().withColumn(f"_{s}", F.lit(True))
    return pairs.join(mark(left), left, "left").join(mark(right), right, "left").where(F.coalesce(f"_{left}", f"_{right}").isNotNull()).select(*pairs.columns)
