"""Semi-joins of wide rows with many ids, without shuffling all of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has so many bits (4 MB), however many ids there are.
BITS = 25


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), column), F.lit(1 << BITS))


def marked(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(row, id, near): whether the bitmap has a row's id; null ids are not near."""
    bitmap = ids.select(_slot(column).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    marked = rows.select(F.struct("*").alias("row"), F.col(column).alias("id"), _slot(column).alias("slot"))
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col("id").isNotNull()
    # 2**BITS bits at most
    return marked.withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(bitmap), "bucket", "left").select("row", "id", told.alias("near"))


def near(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """All rows of which ``column`` is among ``ids`` (no nulls in it), and a few more: rows stay where they are."""
    return marked(rows, ids, column).where("near").select("row.*")


def semi_join(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of which ``column`` is among ``ids``'s column of that name (no nulls in it).

    A bitmap of the ids' hashes, of fixed size and hence safe to broadcast, drops
    most rows where they are read; the rest meets the ids in an ordinary join.
    With very many ids the bitmap fills and only that join remains.
    """
    # an inner join with distinct ids: a semi-join would be pushed below the bitmap
    return marked(rows, ids, column).where("near").join(ids.select(F.col(column).alias("id")).distinct(), "id").select("row.*")


def anti_join(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The other rows, those with a null in ``column`` among them: rows that the bitmap lacks stay where they are."""
    near = marked(rows, ids, column)
    gone = ids.select(F.col(column).alias("id")).distinct().withColumn("gone", F.lit(True))
    # an outer join, for the same reason
    kept = near.where("near").join(gone, "id", "left").where(F.col("gone").isNull())
    return near.where("not near").select("row.*").unionAll(kept.select("row.*"))
