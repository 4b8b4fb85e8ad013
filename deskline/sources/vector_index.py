"""The neighbour search's cells, kept beside a store's vectors.

A first batch chooses the pivots.  Each batch of the store is then assigned to their
cells once: its rows go to folders by cell, with the number and the angles of each cell's rows and,
for all batches but the first, the ids it has written or deleted.  A search opens only the folders of cells it
visits and leaves out rows whose id a later batch has.  So new vectors cost the work on
themselves, and what is searched is never assigned again.

A generation of pivots ends when the store's first batch is another one (it was compacted or
repeated), or when the rows have grown to GROWTH times what the pivots were chosen for:
then all batches are assigned once more, which over time adds a constant share of work.

One manifest row per `follow` names all folders that count and is written last, as in the
store.  One job at a time writes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.constants import SEARCH_NEIGHBOURS
from deskline.operators import similar
from deskline.operators.memo import micros
from deskline.session import cut
from deskline.sources import schemas
from deskline.sources.store import Store

GROWTH = 4  # times as many rows as the pivots were chosen for

_ROWS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("c_vec", T.ArrayType(T.FloatType())),
        T.StructField("c_at", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("_hash", T.LongType()),
        T.StructField("part", T.StringType()),
        T.StructField("cell", T.IntegerType()),
    ]
)
_STATS = "cell int, n long, low double, high double"
_IDS = "id string, batch long"


class VectorIndex:
    """Cells of `store.vectors()`; `follow` brings them up to date, `nearest` searches them.

    Vectors of another length than most had when the pivots were chosen, or with a null
    in them, are not in the index, as `similar.nearest` leaves them out.
    """

    def __init__(self, store: Store, root: str | None = None):
        self.store, self.spark = store, store.spark
        self.root = (root or f"{store.root}/vector-index").rstrip("/")
        self.compared = 0  # pairs of vectors that the last search compared at most

    # ---- writing -------------------------------------------------------------------

    def manifest(self) -> Row | None:
        try:
            rows = self.spark.read.schema(schemas.INDEX_MANIFEST).parquet(f"{self.root}/manifests")
            return rows.orderBy(F.desc("attempt")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def follow(self) -> list[int]:
        """Takes in what the store has and the index has not; the batches whose rows were assigned."""
        sources = self.store.files("vectors")
        known = self.manifest()
        generation = known["generation"] if known and self._goes_on(known, sources) else self._new_generation()
        kept = known["parts"] if known and generation["folder"] == known["generation"]["folder"] else []
        parts = {p["batch"]: p.asDict() for p in kept if sources.get(p["batch"]) == p["source"]}
        missing = sorted(sources.keys() - parts.keys())
        pivots = self._pivots(generation)
        for batch in missing:
            parts[batch] = self._part(generation, pivots, batch, sources[batch], first=batch == min(sources))
        if known and not missing and len(parts) == len(known["parts"]):
            return []
        row = (known["attempt"] + 1 if known else 0, generation, [parts[b] for b in sorted(parts)])
        self.spark.createDataFrame([row], schemas.INDEX_MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifests")
        return missing

    def _goes_on(self, known: Row, sources: dict[int, str]) -> bool:
        parts = {p["batch"]: p for p in known["parts"]}
        if not parts or not known["generation"]["length"] or min(parts) != min(sources, default=None):
            return False
        if parts[min(parts)]["source"] != sources[min(sources)]:
            return False
        new = [path for batch, path in sources.items() if batch not in parts or parts[batch]["source"] != path]
        same = sum(p["rows"] for p in known["parts"] if sources.get(p["batch"]) == p["source"])
        rows = same + (self.spark.read.schema(schemas.VECTOR_UPDATES).parquet(*new).count() if new else 0)
        return rows <= GROWTH * known["generation"]["rows"]

    def _new_generation(self) -> dict:
        vectors = self.store.vectors()
        length = similar.length_of(vectors)
        usable = vectors.where(similar.is_usable(length)).select("id", F.col("embedding").alias("c_vec"))
        rows = usable.count()
        folder = f"{self.root}/generation-{uuid.uuid4().hex}"
        pivots = similar.pivots_of(usable, similar.cells_wanted(rows, similar.CHUNK_ROWS))
        frame = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
        frame.coalesce(1).write.parquet(f"{folder}/pivots")
        return {"folder": folder, "length": length, "rows": rows}

    def _pivots(self, generation) -> np.ndarray:
        """At most `similar.MAX_CELLS` vectors."""
        rows = self.spark.read.schema("cell int, pivot array<double>").parquet(f"{generation['folder']}/pivots").collect()
        return np.array([r["pivot"] for r in sorted(rows, key=lambda r: r["cell"])])

    def _part(self, generation, pivots: np.ndarray, batch: int, source: str, first: bool) -> dict:
        rows = self.spark.read.schema(schemas.VECTOR_UPDATES).parquet(source)
        name = uuid.uuid4().hex
        if not first:
            ids = rows.select("id", F.lit(batch).cast("long").alias("batch"))
            ids.write.parquet(f"{generation['folder']}/ids/{name}")
        usable = rows.where(~F.col("deleted") & similar.is_usable(generation["length"])).select(
            "id",
            F.col("embedding").alias("c_vec"),
            micros(F.col("created_at")).alias("c_at"),
            "category",
            F.lit(batch).cast("long").alias("batch"),
            F.xxhash64("embedding").alias("_hash"),
        )
        count = 0
        if len(pivots):
            spread = cut(similar.in_cells(usable, pivots), "spread")
            stats = cut(similar.cell_stats(spread), "cell-stats")
            count = stats.agg(F.sum("n")).first()[0] or 0
        if count:
            stats.coalesce(1).write.parquet(f"{generation['folder']}/stats/{name}")
            # A crowded cell is a range of its own and more than one file; a small one shares a task.
            laid = spread.drop("angle").withColumn("_place", F.xxhash64("id")).repartitionByRange("cell", "_place").drop("_place")
            laid.write.partitionBy("cell").parquet(f"{generation['folder']}/cells/part={name}")
        return {"batch": batch, "source": source, "name": name, "rows": count}

    # ---- reading --------------------------------------------------------------------

    def _rows(self, known: Row, cells: list[int]) -> DataFrame:
        """Rows of these cells that no later batch has replaced or deleted."""
        folder = known["generation"]["folder"]
        paths = [f"{folder}/cells/part={p['name']}" for p in known["parts"] if p["rows"]]
        if not paths:
            return self.spark.createDataFrame([], _ROWS)
        rows = self.spark.read.schema(_ROWS).option("basePath", f"{folder}/cells").parquet(*paths)
        rows = rows.where(F.col("cell").isin(cells)) if cells else rows.where(F.lit(False))
        later = [f"{folder}/ids/{p['name']}" for p in known["parts"][1:]]
        if not later:
            return rows
        last = self.spark.read.schema(_IDS).parquet(*later).groupBy("id").agg(F.max("batch").alias("_last"))
        return rows.join(last, "id", "left").where(F.coalesce(F.col("_last") <= F.col("batch"), F.lit(True))).drop("_last")

    def nearest(
        self,
        queries: DataFrame,
        k: int = SEARCH_NEIGHBOURS,
        category: str | None = None,
        as_of: bool = False,
        exclude_self: bool = False,
        chunk_rows: int = similar.CHUNK_ROWS,
    ) -> DataFrame:
        """As `similar.nearest` over the store's vectors that were followed, with the same result.

        queries: `query_id, embedding` (and `at`, microseconds as `memo.micros` gives them,
        with as_of); query_id is unique.  as_of considers vectors with an earlier `created_at`.
        An index that has followed nothing, or only vectors it cannot use, finds nothing.
        """
        known = self.manifest()
        length = known["generation"]["length"] if known else None
        at = F.col("at").cast("bigint") if as_of else F.lit(0).cast("bigint")
        q = queries.where(similar.is_usable(length)).select("query_id", F.col("embedding").alias("q_vec"), at.alias("q_at"))
        need = k + 1 if exclude_self else k
        if as_of:
            q = q.where(F.col("q_at").isNotNull())

        def rows_in(cells: list[int]) -> DataFrame:
            rows = self._rows(known, cells)
            if category is not None:
                rows = rows.where(F.col("category") == category)
            rows = rows.where(F.col("c_at").isNotNull()) if as_of else rows.withColumn("c_at", F.lit(0).cast("bigint"))
            return similar.first_copies(rows.drop("batch", "part"), need, as_of)

        stats = [f"{known['generation']['folder']}/stats/{p['name']}" for p in known["parts"] if p["rows"]] if known else []
        self.compared = 0
        if not stats:
            empty = self.spark.createDataFrame([], "id string, category string, at long, sim double")
            found = empty.join(q.select("query_id"), F.lit(False))
        else:
            cells = similar.cells_of(self._pivots(known["generation"]), self.spark.read.schema(_STATS).parquet(*stats))
            found, self.compared = similar.search_cells(q, rows_in, cells, need, as_of, exclude_self, chunk_rows)
        return similar.best_of(found, k, as_of, exclude_self)
