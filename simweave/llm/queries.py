"""The queries of the operators in this subpackage over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm import oracles
from simweave.llm.cotrain import quality
from simweave.llm.crf import identify
from simweave.llm.ftrl import toxicity
from simweave.llm.hyperminhash import near_duplicates
from simweave.llm.mih import nearest
from simweave.llm.mixing import taken_words
from simweave.llm.pathtree import Rule, host_and_path, judge
from simweave.llm.qgram import contaminated
from simweave.llm.resharding import resharded
from simweave.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3).drop("shards")


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_min_cost_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharded(_table(spark, sf_dir, "documents"), new_shards=24, old_shards=16)


#: The rules that the query must apply: fixed values.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


#: A number of 18 digits at most, the last in a path.
LAST_NUMBER = r"(?:^|[^0-9])([0-9]{1,18})[^0-9]*$"


def op7_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number in a page's path is the document that was taken from it; that document's quality label is the page's."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], LAST_NUMBER, 1)
    of = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return judge(pages, of.join(labels, "doc_id").select("page_id", "good"), URL_RULES)


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8, shingle=2)


def op9_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_multi_index_hashing, op2_ftrl_toxicity, op3_cotrained_quality, op4_splitting_tree_mix, op5_crf_language, op6_min_cost_flow_reshard, op7_path_template_tree, op8_hyperminhash, op9_warc_capture_index, op10_qgram_decontamination)}


def oracle_sql() -> dict[str, str]:
    """The others use hashes, learned models or searches that SQL cannot express; tests hold them against brute force."""
    return {"op4_splitting_tree_mix": oracles.OP4_SQL, "op7_path_template_tree": oracles.op7_sql(URL_RULES, LAST_NUMBER), "op8_hyperminhash": oracles.OP8_SQL, "op9_warc_capture_index": oracles.OP9_SQL}
