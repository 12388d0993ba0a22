"""Running sums and numbers of rows along an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256


def running(rows: DataFrame, group: list[str], part: Column, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows before this one in ``order``, of which ``part`` is a coarse prefix.

    The first window runs over the parts' sums, the second inside a part. ``rows`` should be a written table: it is read twice.
    """
    rows = rows.withColumn("_part", part)
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_part").agg(F.sum(value).alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*group, "_part"]).withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_part", "_ahead", "_inside")


def numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``nth``, from 0 in each group: rows (..., id) of a group are interchangeable, and no task numbers a whole group."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_one", F.lit(1))
    return running(salted, group, F.col("_salt"), ["id"], "_one", "nth").drop("_salt", "_one")
