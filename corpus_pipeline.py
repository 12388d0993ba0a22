"""A corpus pipeline: quality, near-duplicates, decontamination, mix, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows of ``docs`` and returns what is kept. All but the last return
the columns of ``documents``. ``run`` writes every stage's result as Parquet to
the shared folder and reads it again for the next one, so a lost executor costs
part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm.cotrain import kept
from simweave.llm.hyperminhash import near_duplicates
from simweave.llm.mixing import mixed
from simweave.llm.qgram import clean
from simweave.llm.resharding import resharded
from simweave.llm.sifting import anti_join
from simweave.scratch import materialize
from simweave.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Every row is judged for itself: repeats share their fate, a null or blank
    text is scored like any other, a null doc_id has no label. Without labels of
    both classes, and for an empty table, nothing is rejected.
    """
    return kept(docs, _table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Of rows that agree in doc_id and text one stays, the smallest as JSON. Rows
    that share a doc_id and differ in text are documents of their own, with a
    hash above all usual ids for a name: only those go that are near another
    document. Rows with a null doc_id, and null or blank texts, all stay but
    for such repeats. An empty table gives an empty one.
    """
    ship(spark)
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"), F.count("*").alias("n"))
    several = materialize(several.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("differ")), "several")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3)
    named = rows.join(several, "doc_id", "left").select("row", "text", F.col("differ").isNotNull().alias("again"), F.when(F.col("differ"), own).otherwise(F.col("doc_id")).alias("name"))
    gone = near_duplicates(named.select(F.col("name").alias("doc_id"), "text"), threshold=0.8, shingle=5).where("not kept").select(F.col("doc_id").alias("name"))
    rest = anti_join(named, materialize(gone, "gone"), "name")
    once = rest.where("again").groupBy("name").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.where("not again").select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Null and blank texts stay, repeats share their fate; without benchmark items, and for an empty table, nothing goes."""
    return clean(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 1, 2, 3: a row for each time a document is drawn, three at most. Null sources are one source, the last; ties in the permuted order go by block number; an empty table gives an empty one."""
    ship(spark)
    return mixed(docs, weights=(1, 2, 3), max_repeats=3)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, which is written as shards to the shared folder. No row is left out: null and repeated doc_ids and null texts are rows like others; an empty table gives an empty one."""
    ship(spark)
    return resharded(docs, new_shards=24, old_shards=16)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier cannot be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
