"""The stores of one desk: tickets, feedback, vectors and memo, written batch by batch.

A batch has a number.  Its rows are written to new folders first, one per table;
then one manifest row names all of them.  That row is a single file, so readers
see a batch in all tables or in none, and a job that died before it has left
nothing but unread files.  The last manifest of a number counts: a repeated batch
replaces itself, in its old place in the order.  One job at a time writes.

Nothing is rewritten when tickets are corrected or vectors change.  Corrections
are the feedback log, applied when tickets are read.  Vectors are updates and
deletions beside the rows they concern, folded when they are read: only the ids
of later batches are looked for in the first one.  `compact` writes all of it
once more as one batch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.operators.corrections import as_corrections, corrected_tickets
from deskline.sources import schemas

TABLES: dict[str, T.StructType] = {
    "tickets": schemas.TICKETS,
    "feedback": schemas.FEEDBACK,
    "vectors": schemas.VECTOR_UPDATES,
    "memo": schemas.MEMO,
    "refused": schemas.REFUSED,
    "pending": schemas.CORRECTIONS,
    "figures": schemas.FIGURES,
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- batches -------------------------------------------------------------------

    def manifests(self) -> list[dict]:
        """The manifest of each batch that counts, by number; a row per batch, never of the data's size."""
        try:
            rows = self.spark.read.schema(schemas.MANIFEST).parquet(f"{self.root}/manifests").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        last: dict[int, dict] = {}
        for row in sorted(rows, key=lambda r: r["attempt"]):
            last[row["batch"]] = row.asDict()
        base = max((n for n, m in last.items() if m["base"]), default=None)
        return [last[n] for n in sorted(last) if base is None or n >= base]

    def commit(self, batch: int, tables: dict[str, DataFrame], base: bool = False) -> None:
        """Writes the rows of each table, then makes them visible together."""
        if unknown := tables.keys() - TABLES.keys():
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        known = self.manifests()
        if not base and any(m["base"] and batch <= m["batch"] for m in known):
            raise ValueError(f"batch {batch} is part of a compacted one and cannot be written again")
        attempt = max((m["attempt"] for m in known if m["batch"] == batch), default=-1) + 1
        files = {}
        for name, rows in tables.items():
            files[name] = f"{self.root}/{name}/batch={batch}/{attempt}-{uuid.uuid4().hex}"
            shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
            shaped.write.parquet(files[name])
        manifest = self.spark.createDataFrame([(batch, attempt, base, files)], schemas.MANIFEST)
        manifest.coalesce(1).write.mode("append").parquet(f"{self.root}/manifests")

    def files(self, table: str, before: int | None = None) -> dict[int, str]:
        """The folder of each batch that has written the table, by number."""
        found = {m["batch"]: m["files"][table] for m in self.manifests() if table in m["files"]}
        return {n: path for n, path in found.items() if before is None or n < before}

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those with a lower number, as they were written."""
        return self._rows(table, list(self.files(table, before).values()))

    def _rows(self, table: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    # ---- tables as they are now ---------------------------------------------------------

    def tickets(self, before: int | None = None) -> DataFrame:
        """Tickets with the logged corrections applied, the latest winning."""
        return corrected_tickets(self.read("tickets", before), as_corrections(self.read("feedback", before)))

    def vectors(self, before: int | None = None) -> DataFrame:
        """One row per id: the update of the highest batch, none where that is a deletion."""
        paths = self.files("vectors", before)
        columns = schemas.VECTORS.fieldNames()
        if not paths:
            return self._rows("vectors", []).select(*columns)
        first, *later = (paths[n] for n in sorted(paths))
        base = self._rows("vectors", [first]).where(~F.col("deleted"))
        if not later:
            return base.select(*columns)
        updates = self._rows("vectors", later)
        newest = Window.partitionBy("id").orderBy(F.desc("batch"))
        last = updates.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
        # The first batch is joined with ids only, and stays where it is while those are few.
        kept = base.join(updates.select("id"), "id", "left_anti")
        return kept.select(*columns).unionByName(last.where(~F.col("deleted")).select(*columns))

    def pending(self, before: int | None = None) -> DataFrame:
        """Corrections that wait for their tickets: those that the last batch with corrections left."""
        paths = self.files("pending", before)
        return self._rows("pending", [paths[max(paths)]] if paths else [])

    # ---- upkeep ---------------------------------------------------------------------

    def compact(self) -> None:
        """All batches as one, numbered as the last of them; earlier numbers cannot be written again."""
        known = self.manifests()
        if len(known) < 2:
            return
        last = known[-1]["batch"]
        rows = {
            "tickets": self.tickets(),
            "vectors": self.vectors().withColumns({"deleted": F.lit(False), "batch": F.lit(last)}),
            "pending": self.pending(),
        }
        rows |= {name: self.read(name) for name in ("feedback", "memo", "refused", "figures")}
        written = reduce(lambda names, m: names | m["files"].keys(), known, set())
        self.commit(last, {name: df for name, df in rows.items() if name in written}, base=True)
