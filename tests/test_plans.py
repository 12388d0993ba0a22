"""Plans that matter at scale: what is pushed to scans, what is not formed."""

from pyspark.sql import functions as F

from simweave.operators import exclusions, incremental
from simweave.plans import queries as q
from simweave.plans import report
from simweave.plans import tables as t
from simweave.sources.store import Store


def plan(df):
    return df._jdf.queryExecution().toString()


def test_point_lookups_reach_the_scan(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.replace("files", spark.createDataFrame([("a", "1", 1.0)], "file_path string, checksum string, mtime double"))
    assert "EqualTo(file_path,a)" in plan(s.get("files", "a"))


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(q.file_checksum_md5(spark, sf_dir))
    read = text[text.index("ReadSchema") :]
    assert "n_chars" not in read and "lang" not in read


def test_deletions_by_either_side_are_equi_joins(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("l"), F.col("id").cast("string").alias("r"))
    gone = spark.createDataFrame([("1",)], "file_path string")
    text = plan(incremental.delete_by_either(rows, gone, "l", "r"))
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("LeftAnti") >= 2


def test_exact_exclusions_are_an_anti_join(spark):
    rows = spark.createDataFrame([("function", "a", "b")], "unit_type string, left_label string, right_label string")
    text = plan(exclusions.exclude_pairs(rows, ["function|a|b"]))
    assert "LeftAnti" in text and "NestedLoop" not in text


def test_top_pairs_are_not_sorted_whole(spark, sf_dir):
    pairs = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("similarity"))
    assert "TakeOrderedAndProject" in plan(report.top(pairs))
