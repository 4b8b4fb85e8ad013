"""Checks on incoming tickets and corrections, and the derived ticket texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import (
    CATEGORIES,
    DESCRIPTION_MAX,
    DESCRIPTION_MIN,
    FEEDBACK_MAX,
    TITLE_MAX,
)
from deskline.functions.text import memo_key, stored_title, ticket_text, vector_text


def ticket_problem(title: Column, description: Column) -> Column:
    """Why a ticket is refused; null when it is accepted."""
    size = F.length(description)
    return (
        F.when(F.length(title) > TITLE_MAX, "title too long")
        .when(description.isNull(), "description missing")
        .when(size < DESCRIPTION_MIN, "description too short")
        .when(size > DESCRIPTION_MAX, "description too long")
    )


def correction_problem(category: Column, feedback: Column) -> Column:
    """Why a correction is refused; null when it is accepted."""
    return F.when(~F.coalesce(category.isin(CATEGORIES), F.lit(False)), "unknown category").when(
        F.length(feedback) > FEEDBACK_MAX, "feedback too long"
    )


def checked(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("problem", ticket_problem(F.col("title"), F.col("description")))


def accepted(tickets: DataFrame) -> DataFrame:
    """Tickets that pass the intake rules."""
    return checked(tickets).where(F.col("problem").isNull()).drop("problem")


def rejected(tickets: DataFrame) -> DataFrame:
    """Refused tickets with the reason in `problem`."""
    return checked(tickets).where(F.col("problem").isNotNull())


def with_texts(tickets: DataFrame) -> DataFrame:
    """Adds stored_title, full_text, vector_text and the memo key."""
    title, description = F.col("title"), F.col("description")
    full = ticket_text(title, description)
    return tickets.withColumns(
        {
            "stored_title": stored_title(title, description),
            "full_text": full,
            "vector_text": vector_text(title, description),
            "memo_key": memo_key(full),
        }
    )
