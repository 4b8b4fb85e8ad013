import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

from deskline.operators import similar


def brute_force(queries, corpus, k, as_of=False, exclude_self=False, category=None):
    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v

    out = {}
    for qid, qv, qt in queries:
        scored = []
        for cid, cv, ct, cat in corpus:
            if (as_of and ct >= qt) or (exclude_self and cid == qid) or (category and cat != category):
                continue
            scored.append((-round(float(unit(qv) @ unit(cv)), 9), ct if as_of else 0, cid))
        out[qid] = [(c, min(max(-s, 0.0), 1.0)) for s, _, c in sorted(scored)[:k]]
    return {q: n for q, n in out.items() if n}


def data(kind):
    rnd = np.random.default_rng(3)
    if kind == "clustered":
        centres = rnd.normal(size=(6, 8)) * 5
        vecs = [centres[i % 6] + rnd.normal(size=8) * 0.3 for i in range(240)]
    elif kind == "copies":  # a third of all rows are the same vector
        same = rnd.normal(size=8)
        vecs = [same if i % 3 == 0 else rnd.normal(size=8) for i in range(240)]
    else:
        vecs = [rnd.normal(size=8) for _ in range(240)]
    vecs[17] = np.zeros(8)
    vecs[50] = np.zeros(8)
    # Values a float holds exactly, so that both sides see the same numbers.
    vecs = [np.round(np.array(v) * 64) / 64 for v in vecs]
    times = rnd.permutation(240) // 2  # pairs of equal times
    return [(i, v, int(t), f"c{i % 4}") for i, (v, t) in enumerate(zip(vecs, times))]


def frames(spark, rows):
    c = spark.createDataFrame([(i, [float(x) for x in v], t, cat) for i, v, t, cat in rows], "id long, embedding array<float>, at long, category string")
    return c.select(F.col("id").alias("query_id"), "embedding", "at"), c


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.similarity))
    return out


HOW = [{}, {"exclude_self": True}, {"as_of": True}, {"exclude_self": True, "category": "c1"}]
CASES = [("copies", how, 20) for how in HOW] + [("clustered", HOW[0], 20), ("clustered", HOW[2], 20), ("spread", HOW[1], 20)]
CASES += [("copies", HOW[1], 10_000), ("spread", HOW[2], 10_000)]


@pytest.mark.parametrize("kind,how,chunk_rows", CASES)
def test_exact_on_any_data(spark, kind, how, chunk_rows):
    rows = data(kind)
    queries, corpus = frames(spark, rows)
    got = collected(similar.nearest(queries, corpus, 3, chunk_rows=chunk_rows, **how))
    want = brute_force([r[:3] for r in rows], rows, 3, **how)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_empty_and_small_corpora(spark):
    queries, corpus = frames(spark, data("spread"))
    assert similar.nearest(queries, corpus.where("false"), 3).count() == 0
    assert similar.nearest(queries.where("false"), corpus, 3).count() == 0
    two = collected(similar.nearest(queries, corpus.where("id < 2"), 5))
    assert {len(n) for n in two.values()} == {2}


def test_missing_times_and_values(spark):
    rows = [(0, [1.0, 0.0], 1, "a"), (1, [float("nan"), 1.0], 2, "b"), (2, [1.0, 0.1], None, "c"), (3, None, 3, "d"), (4, [1.0, 0.2], 4, "e")]
    c = spark.createDataFrame(rows, "id long, embedding array<float>, at long, category string")
    q = c.select(F.col("id").alias("query_id"), "embedding", "at")
    for chunk_rows in (1, 100):
        got = collected(similar.nearest(q, c, 3, as_of=True, chunk_rows=chunk_rows))
        assert {k: [i for i, _ in v] for k, v in got.items()} == {1: [0], 4: [0, 1]}
        assert got[1] == [(0, 0.0)] and got[4][1] == (1, 0.0)


def test_distant_cells_are_left_out(spark):
    rows = data("clustered")
    rows = [r for r in rows if np.linalg.norm(r[1])]
    pivots = np.array([v / np.linalg.norm(v) for _, v, _, _ in rows[:6]])
    angles = similar._angles(np.array([v / np.linalg.norm(v) for _, v, _, _ in rows]), pivots)
    cell = angles.argmin(axis=1)
    high = np.array([angles[cell == i, i].max() for i in range(6)])
    # From the centre of one cluster most others are out of reach of a 0.9 bound.
    reach = np.cos(np.maximum(0, angles[0] - high)) >= 0.9
    assert reach[cell[0]] and reach.sum() < 6


def test_plan_has_no_cross_join_and_thins_before_the_shuffle(spark):
    queries, corpus = frames(spark, data("spread"))
    for chunk_rows in (20, 10_000):
        plan = plan_of(similar.nearest(queries, corpus, 3, chunk_rows=chunk_rows))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "WindowGroupLimit" in plan  # k rows per query and task reach the last shuffle


def test_copies_are_thinned_to_the_first_ones(spark):
    rows = data("copies")
    _, corpus = frames(spark, rows)
    c = corpus.select("id", F.col("embedding").alias("c_vec"), F.col("at").alias("c_at"), "category")
    same = [r for r in rows if np.array_equal(r[1], rows[0][1])]
    assert len(same) == 80
    for timed, key in ((False, lambda r: r[0]), (True, lambda r: (r[2], r[0]))):
        thin = similar.first_copies(c, 4, timed)
        assert thin.count() == 160 + 4
        kept = {r.id for r in thin.collect()} & {r[0] for r in same}
        assert kept == {r[0] for r in sorted(same, key=key)[:4]}
        assert "WindowGroupLimit" in plan_of(thin)
    assert similar.first_copies(c.where(c.id % 3 != 0), 4, False).count() == 160


def test_documents_and_references(spark):
    queries, corpus = frames(spark, data("spread"))
    corpus = corpus.withColumn("document", F.concat(F.lit("doc "), "id"))
    found = similar.nearest(queries, corpus, 3, exclude_self=True)
    assert similar.with_documents(found, corpus).where(F.col("document") != F.concat(F.lit("doc "), "id")).count() == 0
    refs = {r.query_id: r.similar_tickets for r in similar.neighbour_refs(found).collect()}
    for q, listed in collected(found).items():
        assert [(int(r.id), r.similarity) for r in refs[q]] == [(i, pytest.approx(s, abs=0.006)) for i, s in listed]


@pytest.mark.parametrize("early", [True, False])
def test_a_group_needs_little_more_than_its_block_where_very_many_tie(early):
    n, dim = 4096, 8
    edges = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
    vectors = np.ones((n, dim)) if not early else np.random.default_rng(1).normal(size=(n, dim))
    listed = pa.ListArray.from_arrays(edges, pa.array(vectors.ravel()))
    ids, at = pa.array(np.arange(n)), pa.array(np.arange(n))
    asked = pa.array(np.full(n, 2 if early else n))  # two rows are earlier, or all of them, which tie
    queries = pa.table({"query_id": ids, "q_vec": listed, "q_at": asked, "bound": pa.array(np.full(n, -2.0))})
    corpus = pa.table({"id": ids, "c_vec": listed, "c_at": at, "category": pa.array(["c"] * n)})
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("category", pa.string()), ("at", pa.int64()), ("sim", pa.float64())])
    tracemalloc.start()
    found = similar._search_group(3, True, out)(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == n * (2 if early else 3) and max(found["id"].to_pylist()) == (1 if early else 2)
    assert peak < 4.5 * 8 * similar.BLOCK_ELEMENTS
