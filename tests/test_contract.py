"""Each query of the engine against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tablewright import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = contract.QUERIES[name](spark, SF)
    want = db.sql(contract.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = sorted(repr([plain(v) for v in r]) for r in got.collect())
    b = sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(contract.QUERIES) <= set(__spark_entry__.queries())
