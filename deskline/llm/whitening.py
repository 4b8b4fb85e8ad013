"""Whitening components of vectors by shifted CholeskyQR.

The distinct vectors, centred, are the rows of a tall matrix A.  Every pass sums
the Gram matrix of the rows as they stand after the triangular solves so far, and
factors it (R'R = Gram); the next pass solves by this R as well, so the rows come
nearer to orthonormal each time.  The first factor is that of the column norms,
the second has a shift on the diagonal, which keeps it positive however nearly
dependent columns are.  The product of all factors is the R of A = QR, and the SVD
of that small matrix has the components of A, to the accuracy of A itself and
not that of its square.

A pass is one scan of the written table of distinct vectors; tasks send d rows of
their d x d sums, which are added row by row, and the driver sees d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskline.session import cut

COMPONENTS = 4
GRID = 256  # a vector's entries are rounded down to 1 / GRID
CELLS = 1 << 19  # numbers worked on at a time
PASSES = 12  # more than are ever needed; each one squares what is left of the error
DEPENDENT = 1e-10  # a column is a sum of those before it when less than this is left of its square
NOISE = 1e-13  # components of less than this, squared, part of the largest one are none

_PART = "i long, sums binary"


class Fitted(NamedTuple):
    """n distinct vectors with the sums `total`; components as columns, by falling eigenvalue."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def on_grid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`x`, the entries as whole numbers, beside the other columns; rows with a null, NaN or infinite entry are left out.

    Numbers beyond a long are the nearest long.  So are rows of no entries and
    rows of another length than most of the others (of equally frequent lengths
    the longest counts): they are in no common space.
    """
    entries = F.transform(column, lambda c: c.cast("double"))
    sound = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(
        column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    found = vectors.where(sound)
    lengths = found.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d"))
    most = lengths.first()
    length = most["d"] if most else 0
    return found.where(F.size(column) == length).withColumn("x", F.transform(entries, lambda c: F.floor(c * GRID)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The x of each batch as matrices of whole numbers, CELLS numbers at a time."""
    for batch in batches:
        if batch.num_rows:
            column = batch.column("x")
            flat = column.flatten().to_numpy()
            matrix = flat.reshape(batch.num_rows, -1)
            step = max(1, CELLS // matrix.shape[1])
            for i in range(0, len(matrix), step):
                yield matrix[i : i + step]


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of upper triangular factors, one column after the other; columns with nothing left are 0."""
    for factor in factors:
        out = np.zeros_like(rows)
        for j in range(rows.shape[1]):
            if factor[j, j]:
                out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def _added(spread: DataFrame, work, d: int) -> np.ndarray:
    """The sum over all rows of work(rows), a matrix of d rows: partial sums per task, then per matrix row."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _rows(batches):
            one = work(rows)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "sums": [r.tobytes() for r in total]}, schema=arrow)

    def added(table: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(x) for x in table["sums"].to_pylist()])
        # In one order, whatever order the tasks ended in.
        rows = rows[np.lexsort(rows.T[::-1])]
        return pa.Table.from_pydict({"i": table["i"][:1], "sums": [rows.sum(axis=0).tobytes()]}, schema=arrow)

    arrow = to_arrow_schema(T.StructType().add("i", "long").add("sums", "binary"))
    rows = spread.mapInArrow(parts, _PART).groupBy("i").applyInArrow(added, _PART).collect()
    return np.stack([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["i"])])


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift; rows of columns that depend on those before are 0."""
    d = len(gram)
    r = np.zeros((d, d))
    for j in range(d):
        if gram[j, j] == 0:
            continue
        left = gram[j, j] + shift - r[:j, j] @ r[:j, j]
        if left <= DEPENDENT and not shift:
            continue
        r[j, j] = np.sqrt(left)
        r[j, j + 1 :] = (gram[j, j + 1 :] - r[:j, j] @ r[:j, j + 1 :]) / r[j, j]
    return r


def fit(points: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """The components of the distinct `x` of points; None without any.

    Components whose eigenvalue is 0 but for rounding are left out, so fewer than
    asked for come back where the vectors span fewer dimensions.
    """
    distinct = cut(points.select("x").distinct(), "vectors")
    first = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first["n"], first["d"]
    if not n:
        return None
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    total = [int(r["s"]) for r in sums.orderBy("i").collect()]
    mean = np.array([s / n for s in total])
    factors: list[np.ndarray] = []

    def gram(rows: np.ndarray) -> np.ndarray:
        q = _solved(rows - mean, factors)
        return q.T @ q

    def next_gram() -> np.ndarray:
        return _added(distinct, gram, d)

    norms = np.sqrt(np.diag(next_gram()))
    trace = float(norms @ norms) / n
    factors.append(np.diag(norms))
    scaled = next_gram()
    blocks = max(1, CELLS // d)
    shift = 11 * (blocks * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(1.0, np.linalg.norm(scaled, 2))
    factors.append(_factor(scaled, shift))
    for _ in range(PASSES):
        now = next_gram()
        kept = np.diag(np.diag(now) > DEPENDENT).astype(float)
        if len(factors) > 2 and np.abs(now - kept).max(initial=0) <= 4 * d * np.finfo(float).eps:
            break
        factors.append(_factor(now, 0.0))
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    _, singular, right = np.linalg.svd(r)
    values = singular**2 / n
    some = int(np.sum(values[:components] > NOISE * max(values[0], 1e-300))) if d else 0
    vectors, values = right[:some].T, values[:some]
    # Of the two signs: the largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(some)] < 0, -1.0, 1.0)
    error = 0.0
    if some:
        def product(rows: np.ndarray) -> np.ndarray:
            white = (rows - mean) @ vectors / np.sqrt(values)
            return white.T @ white

        error = float(np.abs(_added(distinct, product, some) / n - np.eye(some)).max())
    return Fitted(n, total, vectors, values, trace, error)


def whitened(points: DataFrame, fitted: Fitted | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of points, and for each component `component, n, deviation, whitened, explained, identity_error`.

    deviation is the exact sum of (n x - total)^2 over the dimensions, null when it is beyond a long.
    """
    added = T.StructType().add("component", "integer").add("n", "long").add("deviation", "long")
    for name in ("whitened", "explained", "identity_error"):
        added = added.add(name, "double")
    schema = T.StructType([points.schema[c] for c in keep if c not in added.names] + added.fields)
    if fitted is None or not len(fitted.eigenvalues):
        return points.sparkSession.createDataFrame([], schema)
    n, values = fitted.n, fitted.eigenvalues
    k = len(values)
    mean = np.array([s / n for s in fitted.total])
    scale = fitted.components / np.sqrt(values)
    explained = values / fitted.trace
    arrow = to_arrow_schema(schema)
    largest = max(map(abs, fitted.total), default=0)

    def deviations(rows: np.ndarray) -> list[int | None]:
        most = max(abs(int(rows.max())), abs(int(rows.min())))
        if (n * most + largest) ** 2 * rows.shape[1] < 1 << 63:
            return ((rows * n - np.array(fitted.total)) ** 2).sum(axis=1).tolist()
        exact = ((rows.astype(object) * n - np.array(fitted.total, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in _rows([batch]):
                white = (rows - mean) @ scale
                row = pa.array(np.repeat(np.arange(at, at + len(rows)), k))
                at += len(rows)
                new = {
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
                    "n": np.full(len(row), n),
                    "deviation": pa.array(deviations(rows), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    "whitened": white.ravel(),
                    "explained": np.tile(explained, len(rows)),
                    "identity_error": np.full(len(row), fitted.identity_error),
                }
                columns = [new[f.name] if f.name in new else batch.column(f.name).take(row) for f in arrow]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow)

    return points.select(*[c for c in keep if c not in added.names], "x").mapInArrow(work, schema)


def components_of(vectors: DataFrame, keep: list[str], column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of every usable vector: `keep` columns and those of `whitened`, a row per component.

    Repeated vectors count once in the fit and have all their rows in the result.
    Null, NaN or infinite entries, no entries, another length than most: no row.
    An empty table, or one in which all vectors are equal: no rows.
    A column of `vectors` named like an output, or `x`, does no harm unless it is in `keep`.
    """
    points = on_grid(vectors.select(*[c for c in keep if c != "x"], column), column).drop(column)
    return whitened(points, fit(points, components), keep)
