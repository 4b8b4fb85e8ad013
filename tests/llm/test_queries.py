"""The registered queries and the pipeline at the smallest scale."""

import duckdb
import pytest
from tests.conftest import SMALL

import __spark_entry__ as entry
import corpus_pipeline
from deskline.llm import oracles, queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ["documents", "benchmark", "labels", "pages", "conversations"]:
        con.sql(f"create view {name} as from '{SMALL}/{name}.parquet'")
    return con


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", list(oracles.all_oracles()))
def test_query_equals_sql(spark, duck, name):
    got = queries.all_queries()[name](spark, SMALL)
    want = duck.sql(oracles.all_oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    where = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in where) for r in want.fetchall())


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == documents.columns
        assert kept.schema.simpleString() == documents.schema.simpleString()
        assert 0 < kept.count() <= docs.count()
        docs = kept
    out = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
