"""Human corrections: the changed tickets, the feedback log, the refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskline.constants import STATUS_CORRECTED
from deskline.operators.intake import correction_problem
from deskline.operators.skew import join_on_key


def checked(corrections: DataFrame) -> DataFrame:
    """Adds `problem`, null for a valid correction."""
    return corrections.withColumn(
        "problem", correction_problem(F.col("corrected_category"), F.col("feedback"))
    )


def valid(corrections: DataFrame) -> DataFrame:
    return checked(corrections).where(F.col("problem").isNull()).drop("problem")


def latest_per_ticket(corrections: DataFrame) -> DataFrame:
    """The last valid correction of each ticket.

    The row_number = 1 filter is applied in each map task before the shuffle,
    so a ticket with very many corrections sends one row per task.
    """
    last_first = Window.partitionBy("ticket_id").orderBy(F.desc("corrected_at"), F.desc("correction_id"))
    return valid(corrections).withColumn("_rank", F.row_number().over(last_first)).where("_rank = 1").drop("_rank")


def corrected_tickets(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """All tickets, with the latest valid correction applied where there is one."""
    last = latest_per_ticket(corrections).select(
        F.col("ticket_id").alias("id"), "corrected_category", "corrected_at"
    )
    joined = tickets.join(last, "id", "left")
    is_corrected = F.col("corrected_category").isNotNull()
    changed = {
        "actual_category": F.coalesce("corrected_category", "actual_category"),
        "status": F.when(is_corrected, STATUS_CORRECTED).otherwise(F.col("status")),
        "updated_at": F.when(is_corrected, F.col("corrected_at")).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in tickets.columns])


def feedback_rows(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """One log row per valid correction of a known ticket.

    old_label is the prediction, also for the second correction of a ticket.
    """
    return log_rows(with_label(tickets, valid(corrections)).where("known"))


def with_label(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections with `old_label`, the prediction of their ticket, and `known`: whether there is one."""
    label = tickets.select(
        F.col("id").alias("ticket_id"), F.col("predicted_category").alias("old_label"), F.lit(True).alias("known")
    )
    joined = join_on_key(corrections, label, "ticket_id", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def log_rows(labelled: DataFrame) -> DataFrame:
    """The feedback log of corrections `with_label`."""
    return labelled.select(
        F.col("correction_id").alias("id"),
        "ticket_id",
        "old_label",
        F.col("corrected_category").alias("new_label"),
        "feedback",
        F.col("corrected_at").alias("created_at"),
    )


def as_corrections(log: DataFrame) -> DataFrame:
    """The feedback log as the corrections it was made of."""
    return log.select(
        F.col("id").alias("correction_id"),
        "ticket_id",
        F.col("new_label").alias("corrected_category"),
        "feedback",
        F.col("created_at").alias("corrected_at"),
    )


def refused_corrections(tickets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that were not applied, with the reason in `problem`."""
    known = tickets.select(F.col("id").alias("ticket_id"))
    unknown = join_on_key(valid(corrections), known, "ticket_id", "left_anti").withColumn(
        "problem", F.lit("ticket not found")
    )
    return checked(corrections).where(F.col("problem").isNotNull()).unionByName(unknown)


def feedback_of_known(feedback: DataFrame, tickets: DataFrame) -> DataFrame:
    """Feedback that remains after tickets were deleted (cascade)."""
    return join_on_key(feedback, tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")


def feedback_orphans(feedback: DataFrame, tickets: DataFrame) -> DataFrame:
    """Feedback whose ticket does not exist."""
    return join_on_key(feedback, tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_anti")
