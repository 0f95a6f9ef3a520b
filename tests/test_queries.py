"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from lakeloom.queries import REGISTRY


def plain(v):
    if isinstance(v, Decimal | float):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf_dir, name):
    run, sql = REGISTRY[name]
    df = run(spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if sql is None:
        return
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in want.columns) for r in rows), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(REGISTRY) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
