"""Exact nearest neighbours by cosine similarity.

The corpus is spread over cells around pivot vectors, the more the larger it
is, and searched in two passes:

1. each query searches the cells nearest to it, which gives a similarity its
   k best neighbours reach for certain;
2. by the triangle inequality on angles, every cell that cannot hold anything
   that similar is left out, and the remaining cells are searched.

Both passes are the same equi-join of queries and corpus on (cell, corpus
chunk, query chunk).  A crowded cell is split into as many chunks as its size
asks for, so every group has a bounded size; a group multiplies its two blocks
as matrices and returns k rows per query, never its pairs.  The result is exact
on any data: what the pivots change is only how much is left out.

Rank is by similarity rounded to RANK_DIGITS, then (where time counts) earlier
first, then lower id, so it does not depend on how the work was split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.constants import SEARCH_NEIGHBOURS
from deskline.operators.skew import frequent_keys, join_on_key
from deskline.session import cut

RANK_DIGITS = 9
CHUNK_ROWS = 16384  # rows of one corpus or query block
MAX_CELLS = 1024  # pivots held by every task: at most this many vectors
SLACK = 1e-6  # on similarities, far above rounding and arccos error
NO_BOUND = -2.0  # below every similarity
BLOCK_ELEMENTS = 4_000_000  # similarities computed at a time in a task


class Cells(NamedTuple):
    """Pivots; per cell the number of its vectors (or more) and between which angles from its pivot they lie."""

    pivots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


# ---- small helpers used inside tasks ---------------------------------------


def _unit(column) -> np.ndarray:
    """List column -> rows of unit length as doubles.

    A zero vector stays zero, and one with a NaN or infinite value becomes zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    rows = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _best(sims: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded value) of each row's k largest values; ties go to the lower column.

    Values below a row's `least` may be missing.  What is picked out is never much more than
    what is returned, also where very many values tie.  The values may be rounded in place.
    """
    hit = sims >= (least - SLACK)[:, None]
    if np.count_nonzero(hit) > 4 * k * len(sims):
        np.round(sims, RANK_DIGITS, out=sims)
        hit = np.ones(sims.shape, bool)
        if sims.shape[1] > k:
            kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k, None]
            hit = sims >= kth
            if np.count_nonzero(hit) > k * len(sims):
                tie = sims == kth
                room = k - (np.count_nonzero(hit, axis=1) - np.count_nonzero(tie, axis=1))
                hit &= ~tie | (np.cumsum(tie, axis=1, dtype=np.int32) <= room[:, None])
    row, col = np.nonzero(hit)
    value = np.round(sims[row, col], RANK_DIGITS)
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    starts = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - starts < k
    return row[keep], col[keep], value[keep]


def _search_group(k: int, timed: bool, schema: pa.Schema):
    def search(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or corpus.num_rows == 0:
            return schema.empty_table()
        order = [("c_at", "ascending"), ("id", "ascending")] if timed else [("id", "ascending")]
        corpus = corpus.take(pc.sort_indices(corpus, sort_keys=order))
        c_unit = _unit(corpus["c_vec"])
        q_unit = _unit(queries["q_vec"])
        least = queries["bound"].to_numpy()
        if timed:
            c_at = corpus["c_at"].to_numpy()
            q_at = queries["q_at"].to_numpy()
        step = max(1, BLOCK_ELEMENTS // len(c_unit))
        rows, cols, sims = [], [], []
        for start in range(0, len(q_unit), step):
            block = q_unit[start : start + step] @ c_unit.T
            if timed:
                block[c_at[None, :] >= q_at[start : start + step, None]] = -np.inf
            row, col, sim = _best(block, k, least[start : start + step])
            seen = np.isfinite(sim)
            rows.append(row[seen] + start)
            cols.append(col[seen])
            sims.append(sim[seen])
        row, col = np.concatenate(rows), np.concatenate(cols)
        out = {
            "query_id": queries["query_id"].take(row),
            "id": corpus["id"].take(col),
            "category": corpus["category"].take(col),
            "at": corpus["c_at"].take(col),
            "sim": pa.array(np.concatenate(sims)),
        }
        return pa.table([out[n] for n in schema.names], names=schema.names).cast(schema)

    return search


def _assign_cells(pivots: np.ndarray, schema: pa.Schema):
    """Adds the nearest pivot and the angle to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            angles = _angles(_unit(batch.column("c_vec")), pivots)
            cell = angles.argmin(axis=1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=schema)

    return assign


def _near_cells(pivots: np.ndarray, sizes: np.ndarray, need: int, schema: pa.Schema):
    """Adds the list of nearest cells that hold `need` vectors together."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            order = np.argsort(_angles(_unit(batch.column("q_vec")), pivots), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            count = np.minimum((held < need).sum(axis=1) + 1, order.shape[1])
            cells = [row[:n].astype(np.int32) for row, n in zip(order, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], schema=schema)

    return near


def _open_cells(pivots: np.ndarray, low: np.ndarray, high: np.ndarray, schema: pa.Schema):
    """Replaces `cells` by the cells that may still hold a neighbour as similar as `bound`."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            angle = _angles(_unit(batch.column("q_vec")), pivots)
            gap = np.maximum(0.0, np.maximum(angle - high, low - angle))
            reach = np.cos(gap) >= batch.column("bound").to_numpy()[:, None] - SLACK
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                reach[i, cells] = False
            cells = [np.flatnonzero(row).astype(np.int32) for row in reach]
            names = [n for n in batch.schema.names if n != "cells"]
            columns = [batch.column(n) for n in names] + [pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return left


# ---- plan building -----------------------------------------------------------


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _in_blocks(queries: DataFrame, corpus: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (each with `cell`) laid out in blocks of bounded size.

    A query goes to every corpus chunk of its cell, a corpus row to every query
    chunk.  `cells` has `cell, corpus_chunks, query_chunks`, at most MAX_CELLS rows.
    """
    cells = F.broadcast(cells)
    left = (
        queries.join(cells, "cell")
        .withColumn("c_chunk", F.explode(F.sequence(F.lit(0), F.col("corpus_chunks") - 1)))
        .withColumn("q_chunk", F.pmod(F.xxhash64("query_id"), F.col("query_chunks")).cast("int"))
    )
    right = (
        corpus.join(cells, "cell")
        .withColumn("c_chunk", F.pmod(F.xxhash64("id"), F.col("corpus_chunks")).cast("int"))
        .withColumn("q_chunk", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)))
    )
    return left, right


def _search(queries: DataFrame, corpus: DataFrame, k: int, timed: bool) -> DataFrame:
    """Equi-joins the two sides block by block; k rows per query and block, none needed below the query's `bound`."""
    block = ["cell", "c_chunk", "q_chunk"]
    left = queries.select(*block, "query_id", "q_vec", "q_at", "bound")
    right = corpus.select(*block, "id", "c_vec", "c_at", "category")
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("category", corpus.schema["category"].dataType),
            T.StructField("at", T.LongType()),
            T.StructField("sim", T.DoubleType()),
        ]
    )
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_search_group(k, timed, _arrow(out)), out)


def _ranked(found: DataFrame, k: int, timed: bool) -> DataFrame:
    order = [F.desc("sim"), F.asc("at"), F.asc("id")] if timed else [F.desc("sim"), F.asc("id")]
    by_query = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _cell_table(df: DataFrame, sizes: dict[int, int], query_sizes: dict[int, int], chunk_rows: int) -> DataFrame:
    rows = [
        (cell, -(-sizes[cell] // chunk_rows), -(-n // chunk_rows))
        for cell, n in query_sizes.items()
        if n and sizes.get(cell)
    ]
    return df.sparkSession.createDataFrame(rows, "cell int, corpus_chunks int, query_chunks int")


def _counts(df: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}


def cells_wanted(size: int, chunk_rows: int) -> int:
    return max(1, min(MAX_CELLS, math.isqrt(size) // 4, size), min(MAX_CELLS, -(-size // chunk_rows)))


def pivots_of(corpus: DataFrame, wanted: int) -> np.ndarray:
    """At most `wanted` corpus vectors, picked by a hash of the id."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).select("c_vec").toArrow()
    return np.unique(_unit(rows["c_vec"]), axis=0)


def in_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds `cell`, the nearest pivot of `c_vec`, and `angle`, the one between them."""
    spread = T.StructType(corpus.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return corpus.mapInArrow(_assign_cells(pivots, _arrow(spread)), spread)


def cell_stats(spread: DataFrame) -> DataFrame:
    """`cell, n, low, high`, a row per cell."""
    return spread.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def cells_of(pivots: np.ndarray, stats: DataFrame) -> Cells:
    """The cells with the statistics of all parts of the corpus; at most MAX_CELLS rows reach the driver."""
    folded = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    sizes, low, high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in folded.collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Cells(pivots, sizes, low, high)


def first_copies(corpus: DataFrame, keep: int, timed: bool) -> DataFrame:
    """Of vectors that are exactly equal only the first `keep` can be among the best.

    They tie in every query, so the earlier or lower ids win.  Hashes that occur
    more often than `keep` are counted first (8 bytes a row, combined map-side);
    only rows with such a hash are ranked, by the whole vector, and thinned in
    each map task before their shuffle.  All other rows stay where they are.
    """
    hashed = corpus if "_hash" in corpus.columns else corpus.withColumn("_hash", F.xxhash64("c_vec"))
    crowded = cut(hashed.groupBy("_hash").count().where(F.col("count") > keep).select("_hash"), "crowded")
    if crowded.isEmpty():
        return hashed.drop("_hash")
    order = [F.asc("c_at"), F.asc("id")] if timed else [F.asc("id")]
    copies = Window.partitionBy("_hash", "c_vec").orderBy(*order)
    frequent = frequent_keys(hashed, "_hash")
    ranked = join_on_key(hashed, crowded, "_hash", "left_semi", frequent).withColumn("_copy", F.row_number().over(copies))
    first = ranked.where(F.col("_copy") <= keep).drop("_copy")
    return join_on_key(hashed, crowded, "_hash", "left_anti", frequent).unionByName(first).drop("_hash")


def length_of(corpus: DataFrame) -> int | None:
    """The length that most vectors of the corpus have."""
    counts = corpus.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("n")).count()
    row = counts.orderBy(F.desc("count"), "n").first()
    return row["n"] if row else None


def is_usable(length: int | None) -> Column:
    if not length:
        return F.lit(False)
    return F.coalesce((F.size("embedding") == length) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))


def refused_vectors(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """The rows whose `embedding` a search of the corpus leaves out."""
    return rows.where(~is_usable(length_of(corpus)))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = SEARCH_NEIGHBOURS,
    category: str | None = None,
    as_of: bool = False,
    exclude_self: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The k most similar corpus rows of each query: `query_id, rank, id, category, similarity`.

    queries: `query_id, embedding` (and `at` with as_of); query_id is unique.
    corpus:  `id, embedding, category` (and `at` with as_of); id is unique.
    category restricts the corpus before the search.  as_of only considers
    corpus rows with a strictly smaller `at` (a bigint: a time or a sequence).
    exclude_self leaves out the corpus row with the query's own id.
    Vectors of another length than most of the corpus, or with a null in them,
    are left out on both sides; `refused_vectors` tells which.
    A query without any candidate has no row.  Similarity is kept within [0, 1].
    """
    if category is not None:
        corpus = corpus.where(F.col("category") == category)
    at = F.col("at").cast("bigint") if as_of else F.lit(0).cast("bigint")
    length = length_of(corpus)
    q = queries.where(is_usable(length)).select(
        "query_id", F.col("embedding").alias("q_vec"), at.alias("q_at")
    )
    c = corpus.where(is_usable(length)).select(
        "id", F.col("embedding").alias("c_vec"), at.alias("c_at"), "category"
    )
    if as_of:  # without a time nothing is known to be earlier
        q, c = q.where(F.col("q_at").isNotNull()), c.where(F.col("c_at").isNotNull())
    need = k + 1 if exclude_self else k
    size = c.count()
    pivots = pivots_of(c, cells_wanted(size, chunk_rows))
    if len(pivots):
        # Written once: both passes have to see the same cells.
        c = cut(in_cells(first_copies(c, need, as_of), pivots), "cells")
        found, _ = search_cells(q, lambda _: c, cells_of(pivots, cell_stats(c)), need, as_of, exclude_self, chunk_rows)
    else:  # nothing to find
        block = {name: F.lit(0) for name in ("cell", "c_chunk", "q_chunk")}
        found = _search(q.withColumns(block | {"bound": F.lit(NO_BOUND)}), c.withColumns(block), need, as_of)
    return best_of(found, k, as_of, exclude_self)


def best_of(found: DataFrame, k: int, timed: bool, exclude_self: bool) -> DataFrame:
    """`query_id, rank, id, category, similarity` from what the blocks found."""
    if exclude_self:
        found = found.where(F.col("query_id") != F.col("id"))
    similarity = F.least(F.greatest(F.col("sim"), F.lit(0.0)), F.lit(1.0))
    return _ranked(found, k, timed).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", "category", similarity.alias("similarity")
    )


def search_cells(
    q: DataFrame,
    rows_in: Callable[[list[int]], DataFrame],
    cells: Cells,
    need: int,
    timed: bool,
    exclude_self: bool,
    chunk_rows: int,
) -> tuple[DataFrame, int]:
    """(what both passes find, the pairs of vectors they compare at most).

    rows_in gives the corpus rows of some cells, each with its `cell`; rows of other
    cells do no harm.  The cells' sizes and angles may be wider than the rows are.
    """
    pivots, n, low, high = cells
    sizes = dict(enumerate(n.tolist()))

    def blocks(asked: DataFrame, counts: dict[int, int]) -> DataFrame:
        counts = {cell: count for cell, count in counts.items() if sizes[cell]}
        return _search(*_in_blocks(asked, rows_in(sorted(counts)), _cell_table(q, sizes, counts, chunk_rows)), need, timed)

    def pairs(counts: dict[int, int]) -> int:
        return sum(count * sizes[cell] for cell, count in counts.items())

    with_cells = T.StructType(q.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])
    q = cut(q.mapInArrow(_near_cells(pivots, n, need, _arrow(with_cells)), with_cells), "queries")
    near = q.select("query_id", "q_vec", "q_at", F.lit(NO_BOUND).alias("bound"), F.explode("cells").alias("cell"))
    near_counts = _counts(near)
    first = cut(_ranked(blocks(near, near_counts), need, timed).drop("rank"), "nearest")

    usable = first.where(F.col("query_id") != F.col("id")) if exclude_self else first
    wanted = need - 1 if exclude_self else need
    bound = usable.groupBy("query_id").agg(
        F.when(F.count("*") >= wanted, F.min("sim")).otherwise(F.lit(NO_BOUND)).alias("bound")
    )
    bounded = q.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(NO_BOUND)))
    with_bound = T.StructType(q.drop("cells").schema.fields + [T.StructField("bound", T.DoubleType()), with_cells["cells"]])
    rest = bounded.select(*with_bound.names).mapInArrow(
        _open_cells(pivots, low, high, _arrow(with_bound)), with_bound
    )
    rest = cut(rest.where(F.size("cells") > 0), "open").select(
        "query_id", "q_vec", "q_at", "bound", F.explode("cells").alias("cell")
    )
    counts = _counts(rest)
    if not counts:
        return first, pairs(near_counts)
    return first.unionByName(blocks(rest, counts)), pairs(near_counts) + pairs(counts)


def with_documents(neighbours: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds the stored text of each neighbour.

    Some tickets are neighbours of very many others, so the join takes the
    heavy ids apart.
    """
    neighbours = cut(neighbours, "neighbours")
    return join_on_key(neighbours, corpus.select("id", "document"), "id", "left")


def vote(neighbours: DataFrame) -> DataFrame:
    """The category that a query's neighbours speak for: `query_id, category, votes, confidence`.

    A neighbour counts by its similarity.  The category with the largest sum wins (to
    RANK_DIGITS decimals), of equal ones the first by name; confidence is
    its share of all similarity, to 2 decimals, 0 where all similarities are 0.
    Neighbours without a category count for none; a query with only such has no row.
    """
    summed = neighbours.where(F.col("category").isNotNull()).groupBy("query_id", "category").agg(
        F.sum("similarity").alias("weight"), F.count("*").alias("votes")
    )
    order = F.struct(-F.round("weight", RANK_DIGITS), F.col("category"))
    best = summed.groupBy("query_id").agg(F.min_by(F.struct("category", "votes", "weight"), order).alias("best"), F.sum("weight").alias("whole"))
    share = F.coalesce(F.try_divide(F.col("best.weight"), F.col("whole")), F.lit(0.0))
    return best.select("query_id", "best.category", "best.votes", F.round(share, 2).alias("confidence"))


def neighbour_refs(neighbours: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per query: `similar_tickets`, best first, similarity to 2 decimals.

    A query has at most k neighbours, so the list is short.
    """
    ref = F.struct("rank", F.col("id").cast("string").alias("id"), "category", F.bround("similarity", 2).alias("similarity"))
    listed = neighbours.groupBy("query_id").agg(
        F.sort_array(F.collect_list(ref)).alias("refs"),
        *[F.sort_array(F.collect_list(F.struct("rank", c.alias("v")))).alias(n) for n, c in (extra or {}).items()],
    )
    return listed.select(
        "query_id",
        F.transform("refs", lambda r: F.struct(r["id"], r["category"], r["similarity"])).alias("similar_tickets"),
        *[F.transform(n, lambda r: r["v"]).alias(n) for n in (extra or {})],
    )
