"""Score, grade, metrics and findings of a set of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simweave.functions.text import grade
from simweave.operators.units import type_counts
from simweave.scratch import materialize


def duplication_score(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """One row (score, grade, total_lines, duplicate_lines, duplicate_groups).

    Lines are end - start + 1. A pair adds its similarity times the mean length
    of its sides; the score is their share of all lines in per cent, from the
    unrounded sum. No lines or no pairs: 0.
    """
    total = units.agg(F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("total_lines"))
    mean = (F.col("left.end_line") - F.col("left.start_line") + 1 + F.col("right.end_line") - F.col("right.start_line") + 1) / 2
    dup = pairs.agg(F.coalesce(F.sum(F.col("similarity") * mean), F.lit(0.0)).alias("dup"), F.count("*").alias("duplicate_groups"))
    # two single rows
    both = total.join(dup)
    score = F.when((F.col("total_lines") == 0) | (F.col("duplicate_groups") == 0), 0.0).otherwise(F.try_divide("dup", "total_lines") * 100)
    return both.select(score.alias("score"), grade(score).alias("grade"), "total_lines", F.round("dup").cast("long").alias("duplicate_lines"), "duplicate_groups")


def scan_metrics(units: DataFrame, files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files, lines, units by type, pairs before and after verdicts."""
    lines = units.agg(F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("total_lines"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(files, "files_scanned").join(lines).join(type_counts(units)).join(count(before, "pairs_before")).join(count(after, "pairs_after"))


def findings(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id, similarity, left, right) -> (file_path, pair_id, similarity, start_line, end_line, other_path): a row for each side of a pair, in the file it is in."""
    one = lambda a, b: pairs.select(F.col(f"{a}.file_path").alias("file_path"), F.col("id").alias("pair_id"), "similarity", F.col(f"{a}.start_line").alias("start_line"), F.col(f"{a}.end_line").alias("end_line"), F.col(f"{b}.file_path").alias("other_path"))
    return one("left", "right").unionByName(one("right", "left"))


def findings_per_file(pairs: DataFrame, shown: int = 100) -> DataFrame:
    """(file_path, findings, shown): the number of a file's findings and its best ``shown``, for display; :func:`findings` has them all."""
    rows = materialize(findings(pairs), "findings")  # read twice
    best = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("similarity"), "pair_id", "other_path", "start_line"))
    # the ranks are cut before the shuffle, so a list holds ``shown`` at most
    top = rows.withColumn("rank", best).where(F.col("rank") <= shown)
    lists = top.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("rank", "pair_id", "similarity", "start_line", "end_line", "other_path"))).alias("shown"))
    return rows.groupBy("file_path").agg(F.count("*").alias("findings")).join(lists, "file_path")
