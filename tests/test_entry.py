import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["left_id", "right_id", "unit_type", "similarity"]
