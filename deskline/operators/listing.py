"""Point lookup, filtered pages and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskline.constants import PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX, RECENT_LIMIT
from deskline.functions.numbers import page_count
from deskline.sources.schemas import TICKETS


def public(tickets: DataFrame) -> DataFrame:
    """The ticket columns as they are shown: id as text."""
    shown = [c for c in TICKETS.fieldNames() if c != "id"]
    return tickets.select(F.col("id").cast("string").alias("id"), *shown)


def ticket_by_id(tickets: DataFrame, ticket_id) -> DataFrame:
    """The ticket with that id, or no row."""
    return public(tickets.where(F.col("id") == F.lit(ticket_id)))


def filtered(tickets: DataFrame, status: str | None = None, category: str | None = None) -> DataFrame:
    """Optional equality filters; None and '' both mean no filter."""
    if status:
        tickets = tickets.where(F.col("status") == status)
    if category:
        tickets = tickets.where(F.col("predicted_category") == category)
    return tickets


def _check(page: int, limit: int) -> None:
    if page < 1 or not 1 <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"page must be at least 1 and limit within 1..{PAGE_LIMIT_MAX}")


def page(
    tickets: DataFrame,
    page: int = 1,
    limit: int = PAGE_LIMIT_DEFAULT,
    status: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """One page, newest first, ties by id.  Runs as a top-n, not as a sort."""
    _check(page, limit)
    chosen = public(filtered(tickets, status, category))
    return chosen.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit)


def page_after(
    tickets: DataFrame,
    last_created_at,
    last_id: str,
    limit: int = PAGE_LIMIT_DEFAULT,
    status: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """The page behind a known last row: deep pages cost no more than the first.

    Stored tickets have a `day` partition; days after the last row's are not read.
    Tickets without a time are on no such page.
    """
    _check(1, limit)
    at = F.lit(str(last_created_at)).cast("timestamp_ntz")
    behind = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last_id))
    if "day" in tickets.columns:
        tickets = tickets.where(F.col("day") <= F.to_date(at))
    chosen = public(filtered(tickets, status, category)).where((F.col("created_at") <= at) & behind)
    return chosen.orderBy(F.desc("created_at"), "id").limit(limit)


def day_counts(tickets: DataFrame) -> DataFrame:
    """`day, status, predicted_category, n`: how many tickets each day has of each kind.

    A rank index for deep pages, a few rows per day; the counts of several batches add up.
    """
    return tickets.groupBy(F.to_date("created_at").alias("day"), "status", "predicted_category").agg(F.count("*").alias("n"))


def page_by_counts(
    tickets: DataFrame,
    counts: DataFrame,
    page: int = 1,
    limit: int = PAGE_LIMIT_DEFAULT,
    status: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """The same rows as `page`, for pages however deep, from tickets stored by `day`.

    The days that the page's rows are of are found in `day_counts`; only those are
    read, and within them the page is at most a day's tickets deep.
    """
    _check(page, limit)
    first = (page - 1) * limit
    per_day = filtered(counts, status, category).groupBy("day").agg(F.sum("n").alias("n"))
    # One row per day by now; tickets without a time come last.
    upto = F.sum("n").over(Window.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, 0))
    days = per_day.withColumn("upto", upto).where((F.col("upto") > first) & (F.col("upto") - F.col("n") < first + limit))
    span = days.agg(
        F.min("day").alias("low"), F.max("day").alias("high"), F.min(F.col("upto") - F.col("n")).alias("before"), F.count_if(F.col("day").isNull()).alias("nulls")
    ).first()
    if span["before"] is None:
        return public(filtered(tickets, status, category)).where(F.lit(False))
    here = F.col("day").between(F.lit(span["low"]), F.lit(span["high"])) if span["low"] is not None else F.lit(False)
    chosen = public(filtered(tickets.where(here | F.col("day").isNull() if span["nulls"] else here), status, category))
    return chosen.orderBy(F.desc("created_at"), "id").offset(first - span["before"]).limit(limit)


def page_totals(
    tickets: DataFrame,
    page: int = 1,
    limit: int = PAGE_LIMIT_DEFAULT,
    status: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """One row: total matching tickets, page, limit and number of pages."""
    _check(page, limit)
    total = filtered(tickets, status, category).agg(F.count("*").alias("total"))
    return total.select(
        "total",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        page_count(F.col("total"), limit).alias("pages"),
    )


def recent(tickets: DataFrame) -> DataFrame:
    """The few newest tickets."""
    return page(tickets, 1, RECENT_LIMIT)
