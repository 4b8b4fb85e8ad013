"""Every registered query against its SQL twin, at the smallest scale."""

import math

import duckdb
import pytest
from tests.conftest import SMALL

import __spark_entry__ as entry_module
from registered.oracles import all_oracles
from registered.queries import all_queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ["events", "documents", "embeddings", "labels", "lineitem"]:
        con.sql(f"create view {name} as from '{SMALL}/{name}.parquet'")
    return con


def rounded(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def test_every_query_has_a_twin():
    assert all_queries().keys() == all_oracles().keys()
    assert all_queries().keys() <= entry_module.queries().keys() and all_oracles().keys() <= entry_module.oracle_sql().keys()


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, duck, name):
    got = all_queries()[name](spark, SMALL)
    want = duck.sql(all_oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    where = [want.columns.index(c) for c in columns]
    left = sorted(repr([rounded(r[c]) for c in columns]) for r in got.collect())
    right = sorted(repr([rounded(r[i]) for i in where]) for r in want.fetchall())
    assert left == right
