"""Whitening against an eigendecomposition of the covariance."""

import numpy as np
import pytest
from tests.conftest import SMALL

from deskline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    """Usable rows as whole numbers, distinct count, sums, eigenvalues (falling), eigenvectors, trace."""
    rows = [(i, np.floor(np.array(v, float) * 256)) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in rows]), axis=0)
    centred = x - x.sum(0) / len(x)
    cov = centred.T @ centred / len(x)
    values, parts = np.linalg.eigh(cov)
    return rows, len(x), x.sum(0), values[::-1], parts[:, ::-1], np.trace(cov)


def check(got, vectors, tolerance=1e-8):
    rows, n, total, values, parts, trace = plain(vectors)
    some = int(np.sum(values[:4] > 1e-12 * values[0])) if values[0] > 0 else 0
    assert len(got) == len(rows) * some
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(some):
        want = np.array([(x - total / n) @ parts[:, k] for _, x in rows]) / np.sqrt(values[k])
        have = np.array([by_row[i][k + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < tolerance
    for i, x in rows:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total))
        deviation = deviation if deviation < 1 << 63 else None
        for k in range(some):
            r = by_row[i][k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["explained"] - values[k] / trace) < 1e-9 and r["identity_error"] < 1e-9


def of(spark, vectors):
    return whitening.components_of(spark.createDataFrame(vectors, SCHEMA), ["vec_id"]).collect()


def test_query(spark):
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, SMALL).collect(), vectors)


@pytest.mark.parametrize("case", ["dependent", "few", "near", "scales", "equal"])
def test_hard_tables(spark, case):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6)) * 100
    if case == "dependent":  # one column constant, one a copy, one a sum
        x[:, 1], x[:, 3] = 2.5, x[:, 0]
        x = np.round(x)
        x[:, 5] = x[:, 0] + x[:, 2]
    elif case == "few":
        x = x[:3]
    elif case == "near":  # two columns that are all but the same
        x[:, 4] = x[:, 2] + rng.integers(0, 2, 150) / 256
    elif case == "scales":
        x *= [1e4, 1, 1e-2, 1, 1e2, 1]
    else:
        x[:] = 1.0
    x = x.astype(np.float32).astype(float)
    vectors = list(enumerate([*x.tolist(), *x[:5].tolist()]))
    check(of(spark, vectors), vectors, 1e-6)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.0]), (None, [2.0, 1.0, 4.0]), (3, [0.5, 1.0, -3.0]), (3, [0.5, 1.0, -3.0])]
    bad = [(4, None), (5, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 2.0]), (8, [1.0, -inf, 2.0]), (9, [1.0, 2.0])]
    got = of(spark, good + bad)
    assert {r["vec_id"] for r in got} == {1, None, 3} and len(got) == 8 and {r["n"] for r in got} == {3}
    assert of(spark, []) == [] and of(spark, bad[:5]) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, 6), (2, [2.0, 9.0], 5, 6)], SCHEMA + ", n int, x int")
    got = whitening.components_of(df, ["vec_id", "n"]).collect()
    assert [r["n"] for r in got] == [2, 2]


def test_beyond_a_long(spark):
    got = of(spark, [(1, [1e30, 1.0]), (2, [2.0, 3.0])])
    assert {r["deviation"] for r in got} == {None}
