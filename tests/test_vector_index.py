"""The stored cells: the same neighbours as a fresh search, new batches alone assigned, fewer cells read."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of
from tests.test_similar import brute_force, collected, data

from deskline.operators import similar, vectors
from deskline.operators.memo import micros
from deskline.plans import store as jobs
from deskline.sources.store import Store
from deskline.sources.vector_index import VectorIndex


def frame(spark, rows):
    made = [(str(i), f"d {i}", cat, [float(x) for x in v], t) for i, v, t, cat in rows]
    df = spark.createDataFrame(made, "id string, document string, category string, embedding array<float>, t int")
    return vectors.vector_rows(df.withColumn("created_at", F.timestamp_seconds("t").cast("timestamp_ntz")))


def asked(spark, rows):
    made = [(str(i), [float(x) for x in v], t * 1_000_000) for i, v, t, _ in rows]
    return spark.createDataFrame(made, "query_id string, embedding array<float>, at long")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


HOW = [{}, {"exclude_self": True}, {"as_of": True}, {"exclude_self": True, "category": "c1"}]


@pytest.mark.parametrize("kind,how", [("copies", HOW[1]), ("copies", HOW[2]), ("clustered", HOW[0]), ("spread", HOW[3])])
def test_batches_updates_and_deletions_equal_brute_force(spark, store, monkeypatch, kind, how):
    monkeypatch.setattr(similar, "CHUNK_ROWS", 20)
    rows = data(kind)
    old = [(i, -np.array(v), 500, "c1") for i, v, _, _ in rows[100:140]]  # replaced by the second batch
    gone = [(1000 + i, v, 0, "c1") for i, v, _, _ in rows[:10]]
    index = VectorIndex(store)
    jobs.store_vectors(store, 0, frame(spark, rows[:100] + old + gone))
    assert index.follow() == [0]
    before = files(index.root)
    jobs.store_vectors(store, 1, frame(spark, rows[100:]))
    jobs.delete_vectors(store, 2, spark.createDataFrame([(str(i),) for i, *_ in gone], "id string"))
    assert index.follow() == [1, 2] and index.follow() == []
    now = files(index.root)
    assert all(now[path] == at for path, at in before.items())  # the first batch was not touched
    assert len(index._pivots(index.manifest()["generation"])) > 1
    named = [(str(i), v, t, cat) for i, v, t, cat in rows]
    got = collected(index.nearest(asked(spark, rows), 3, chunk_rows=20, **how))
    want = brute_force([r[:3] for r in named], named, 3, **how)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_far_cells_are_not_read(spark, store, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_ROWS", 20)
    rows = [r for r in data("clustered") if np.linalg.norm(r[1])]
    index = VectorIndex(store)
    jobs.store_vectors(store, 0, frame(spark, rows))
    index.follow()
    few = [r for r in rows if r[0] % 6 == 0]
    found = collected(index.nearest(asked(spark, few), 3))
    assert len(found) == len(few) and 0 < index.compared < len(few) * len(rows)
    known = index.manifest()
    plan = plan_of(index._rows(known, [0]))
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index._rows(known, [0]).count() < len(rows) == index._rows(known, list(range(100))).count()


def test_a_repeated_batch_is_taken_anew_and_growth_starts_over(spark, store):
    rows = data("spread")
    index = VectorIndex(store)
    jobs.store_vectors(store, 0, frame(spark, rows[:40]))
    jobs.store_vectors(store, 1, frame(spark, rows[40:50]))
    assert index.follow() == [0, 1]
    folder = index.manifest()["generation"]["folder"]
    jobs.store_vectors(store, 1, frame(spark, rows[50:60]))
    assert index.follow() == [1] and index.manifest()["generation"]["folder"] == folder
    assert index._rows(index.manifest(), [0]).count() == 50
    jobs.store_vectors(store, 2, frame(spark, rows[60:]))  # more than GROWTH times
    assert index.follow() == [0, 1, 2] and index.manifest()["generation"]["folder"] != folder
    store.compact()
    assert index.follow() == [2]
    named = [(str(i), v, t, cat) for i, v, t, cat in rows[:40] + rows[50:]]
    got = collected(index.nearest(asked(spark, rows[:9]), 3))
    assert {q: [i for i, _ in n] for q, n in got.items()} == {
        q: [i for i, _ in n] for q, n in brute_force([(str(i), v, t) for i, v, t, _ in rows[:9]], named, 3).items()
    }


def test_empty_stores_and_unusable_vectors(spark, store):
    index = VectorIndex(store)
    queries = asked(spark, data("spread")[:3])
    assert index.nearest(queries, 3).count() == 0
    assert index.follow() == [] and index.nearest(queries, 3).count() == 0
    jobs.store_vectors(store, 0, frame(spark, []))
    assert index.follow() == [0] and index.nearest(queries, 3).count() == 0
    jobs.store_vectors(store, 1, frame(spark, data("spread")[:5]))
    assert index.follow() == [0, 1]
    shorter = spark.createDataFrame([("0", "d", "c1", [1.0])], "id string, document string, category string, embedding array<float>")
    jobs.store_vectors(store, 2, vectors.vector_rows(shorter.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))))
    assert index.follow() == [2]  # it takes the place of vector 0 and cannot be compared
    got = collected(index.nearest(queries, 9))
    assert all({i for i, _ in n} == {"1", "2", "3", "4"} for n in got.values())


def test_times_agree_with_the_store(spark, store):
    jobs.store_vectors(store, 0, frame(spark, data("spread")[:5]))
    index = VectorIndex(store)
    index.follow()
    stored = {r["id"]: r["at"] for r in store.vectors().select("id", micros(F.col("created_at")).alias("at")).collect()}
    assert {r["id"]: r["c_at"] for r in index._rows(index.manifest(), [0]).collect()} == stored
