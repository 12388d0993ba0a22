"""Every library query agrees with its SQL."""

import math
import os

import duckdb
import pytest

from simweave.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 5))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert ours
    if name in registry.oracle_sql():
        q = db.sql(registry.oracle_sql()[name])
        names = list(q.columns)
        theirs = sorted([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in q.fetchall())
        assert columns == sorted(names)
        assert ours == theirs
