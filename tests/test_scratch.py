import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from simweave import scratch
from simweave.scratch import ARROW, discard, materialize, scratch_root


def test_tables_come_and_go(spark):
    before = {k: spark.conf.get(k, None) for k in ARROW}
    df = materialize(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 10 and df.schema["x"].dataType.simpleString() == "string"
    assert {k: spark.conf.get(k, None) for k in ARROW} == before
    path = df._scratch_path.removeprefix("file://")
    assert path.startswith(scratch_root(spark).removeprefix("file://")) and os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)


def test_the_cluster_names_the_folder():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/shared/"})
    assert scratch_root(named) == "hdfs://x/shared"
    bare = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=dict, master="yarn"))
    with pytest.raises(ValueError):
        scratch_root(bare)


def test_what_the_driver_freed_goes_back(spark, monkeypatch):
    said, real, mode = [], scratch.trim_native, spark.conf.get("spark.sql.ui.explainMode")
    monkeypatch.setattr(scratch, "trim_native", lambda s: said.append(real(s)))
    monkeypatch.setattr(scratch, "_TRIMMED", {})
    discard(materialize(spark.range(3), "t"), materialize(spark.range(3), "t"))
    assert len(said) == 1 and "Trim native heap" in said[0]  # not after every one of many small tables
    assert spark.conf.get("spark.sql.ui.explainMode") == mode
