"""Jobs that read a store, do one batch and commit it.

A job with number n reads what batches below n have left, so a repeated one
finds what it found the first time and replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskline.operators import corrections as corr
from deskline.operators import intake
from deskline.plans.classify import Stored, create_and_classify
from deskline.session import cut
from deskline.sources.store import Store


def _refused(rows: DataFrame, kind: str, row_id: str) -> DataFrame:
    content = F.to_json(F.struct(*[c for c in rows.columns if c not in ("problem", "embedding")]))
    return rows.select(F.lit(kind).alias("kind"), F.col(row_id).cast("string").alias("id"), content.alias("content"), "problem")


def store_tickets(store: Store, batch: int, tickets: DataFrame, answers: DataFrame | None = None, **options) -> Stored:
    """Checks, classifies and stores a batch of tickets: tickets, vectors, memo entries, and the refused ones.

    Neighbours are the vectors stored before and the batch's own earlier tickets;
    remembered results are those of earlier batches and the batch's own.
    """
    accepted = intake.accepted(tickets)
    found = create_and_classify(accepted, store.vectors(batch), answers, store.read("memo", batch), **options)
    tables = {"tickets": found.tickets, "memo": found.memo, "refused": _refused(intake.rejected(tickets), "ticket", "id")}
    if found.vectors is not None:
        tables["vectors"] = _updates(found.vectors, batch)
    store.commit(batch, tables)
    return found


def _updates(vectors: DataFrame, batch: int) -> DataFrame:
    return vectors.withColumns({"deleted": F.lit(False), "batch": F.lit(batch).cast("long")})


def store_vectors(store: Store, batch: int, updates: DataFrame, order: str | None = None) -> None:
    """Adds vectors or puts them in the place of those with their id.

    Of updates with one id the one with the highest `order` counts, of equal ones
    that with the larger content hash; without an order ids have to be unique.
    """
    if order is not None:
        newest = Window.partitionBy("id").orderBy(F.desc(order), F.desc(F.xxhash64("document", "category", "embedding")))
        updates = updates.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    store.commit(batch, {"vectors": _updates(updates, batch)})


def delete_vectors(store: Store, batch: int, ids: DataFrame) -> None:
    """Notes the ids as deleted; what they had stays in its files until the store is compacted."""
    gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
    empty = {n: F.lit(None) for n in ("document", "category", "metadata", "embedding", "created_at")}
    store.commit(batch, {"vectors": gone.withColumns(empty | {"deleted": F.lit(True), "batch": F.lit(batch).cast("long")})})


def store_corrections(store: Store, batch: int, corrections: DataFrame, tickets: DataFrame | None = None) -> None:
    """Logs the valid corrections of known tickets; those of unknown ones wait for a later batch.

    What is not valid is refused at once.  `tickets`, classified ones, come in with
    the same batch and are known to it.  All of it becomes visible together.
    """
    columns = ["correction_id", "ticket_id", "corrected_category", "feedback", "corrected_at"]
    given = corrections.withColumns({c: F.col(c).cast("string") for c in columns[:2]}).select(*columns)
    judged = cut(corr.checked(given), "checked")
    valid = judged.where(F.col("problem").isNull()).select(*columns).unionByName(store.pending(batch).select(*columns))
    known = store.read("tickets", batch).select("id", "predicted_category")
    tables = {}
    if tickets is not None:
        tables["tickets"] = tickets.withColumn("id", F.col("id").cast("string"))
        known = known.unionByName(tables["tickets"].select("id", "predicted_category"))
    split = cut(corr.with_label(known, valid), "corrections")
    tables["feedback"] = corr.log_rows(split.where("known"))
    tables["pending"] = split.where("not known").select(*columns)
    tables["refused"] = _refused(judged.where(F.col("problem").isNotNull()), "correction", "correction_id")
    store.commit(batch, tables)


def still_pending(store: Store) -> DataFrame:
    """The waiting corrections as refused ones: their tickets have not come."""
    return _refused(store.pending().withColumn("problem", F.lit("ticket not found")), "correction", "correction_id")
