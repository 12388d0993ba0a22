"""Units of analysis: schema, hierarchy, filters, chunking, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_DDL = "id string, name string, file_path string, start_line int, end_line int, code string, unit_type string, parent_id string, embedding array<float>"
#: A block is never shorter than this, whatever is configured.
LEAST_BLOCK_LINES = 5


def long_enough(unit_type: Column, start: Column, end: Column, min_lines: int, min_block_lines: int) -> Column:
    """Length as end - start; a limit of 0 or less admits all, except that blocks have a floor."""
    least = F.when(unit_type == "block", F.lit(max(LEAST_BLOCK_LINES, min_block_lines))).otherwise(F.lit(max(0, min_lines)))
    return end - start >= least


def latest_by_id(units: DataFrame, sequence: str) -> DataFrame:
    """One row an id, the one with the largest ``sequence``."""
    rest = [c for c in units.columns if c != "id"]
    picked = units.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r"))
    return picked.select("id", *[F.col("r")[c].alias(c) for c in rest])


def split_long(units: DataFrame, length: int) -> DataFrame:
    """Code beyond ``length`` characters becomes chunks with ids ``:chunk0`` on; others stay as they are."""
    size = F.length("code")
    pieces = F.when(size > length, F.sequence(F.lit(0), F.ceil(size / length).cast("int") - 1)).otherwise(F.array(F.lit(None).cast("int")))
    chunk = F.col("chunk")
    return units.withColumn("chunk", F.explode(pieces)).withColumn("id", F.when(chunk.isNull(), F.col("id")).otherwise(F.concat("id", F.lit(":chunk"), chunk.cast("string")))).withColumn("code", F.when(chunk.isNull(), F.col("code")).otherwise(F.substr(F.col("code"), chunk * length + 1, F.lit(length)))).drop("chunk")


def within_context(code: Column, vector: Column, length: int) -> Column:
    """The vector, or null for code that exceeds the context."""
    return F.when(F.length(code) <= length, vector)


def embedded(vector: Column) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) > 0


def with_parents(units: DataFrame, depth: int = 1, of: DataFrame | None = None) -> DataFrame:
    """Adds ``function_id`` and ``class_id``: the ancestors of those types that are ``depth`` (1 or 2) steps away at most. They are looked for in ``units``, or in ``of``."""
    known = units if of is None else of
    up = known.select(F.col("id").alias("p_id"), F.col("unit_type").alias("p_type"), F.col("parent_id").alias("pp_id"))
    one = units.join(up, F.col("parent_id") == F.col("p_id"), "left")
    if depth < 2:
        return one.withColumn("function_id", F.when(F.col("p_type") == "function", F.col("p_id"))).withColumn("class_id", F.when(F.col("p_type") == "class", F.col("p_id"))).drop("p_id", "p_type", "pp_id")
    far = known.select(F.col("id").alias("g_id"), F.col("unit_type").alias("g_type"))
    two = one.join(far, F.col("pp_id") == F.col("g_id"), "left")
    pick = lambda t: F.coalesce(F.when(F.col("p_type") == t, F.col("p_id")), F.when(F.col("g_type") == t, F.col("g_id")))
    return two.withColumn("function_id", pick("function")).withColumn("class_id", pick("class")).drop("p_id", "p_type", "pp_id", "g_id", "g_type")


def type_counts(units: DataFrame) -> DataFrame:
    one = lambda t, n: F.count_if(F.col("unit_type") == t).alias(n)
    return units.agg(one("class", "classes"), one("function", "functions"), one("block", "blocks"), F.count("*").alias("total"))


def with_row_index(units: DataFrame) -> DataFrame:
    """Position of each unit among those of its type, by hash of id, then id: a rank in its partition of ids plus the sizes of those before, so no task sorts a type."""
    b = units.withColumn("b", F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int"))
    sizes = b.groupBy("unit_type", "b").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("unit_type").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("unit_type", "b").orderBy("id")) - 1
    return b.withColumn("row", inside).join(F.broadcast(sizes), ["unit_type", "b"]).withColumn("row", F.col("row") + F.col("ahead")).drop("b", "ahead")


def exact_copies(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` whose ``by`` comes several times, with the class's ``first`` name and the number of ``copies``: a row a member, however large the class."""
    classes = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(name).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(classes, by)
