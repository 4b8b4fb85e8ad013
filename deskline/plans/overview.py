"""The one-row overview over tickets, memo and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.operators.analytics import figures_of, overview_figures, totals_by_category
from deskline.operators.memo import hit_rate, rate_of
from deskline.sources.schemas import FIGURES


def overview(tickets: DataFrame, flagged_requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ticket figures with the memo hit rate and the number of vectors.

    The two other stores enter as scalar subqueries: one value each, no join.
    """
    rate = hit_rate(flagged_requests).select("hit_rate")
    stored = vectors.agg(F.count("*").alias("n"))
    return overview_figures(tickets).select(
        "total_tickets",
        "accuracy",
        "category_distribution",
        "avg_confidence",
        rate.scalar().alias("cache_hit_rate"),
        stored.scalar().alias("vector_store_count"),
    )


def day_figures(tickets: DataFrame | None = None, flagged_requests: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """What a batch adds to the overview: sums by day and category, a few rows whatever its size.

    Rows of `FIGURES`; those of several batches add up.  Days are those of creation, of
    the request and of the vector; a null time is a day of its own.  `vectors` are new
    ones: those that replaced or removed others are not to be counted here.
    """
    parts = []
    if tickets is not None:
        parts.append(totals_by_category(tickets, F.to_date("created_at").alias("day")))
    if flagged_requests is not None:
        counts = [F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")]
        parts.append(flagged_requests.groupBy(F.to_date("ts").alias("day")).agg(*counts))
    if vectors is not None:
        parts.append(vectors.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("vectors")))
    shaped = [p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FIGURES]) for p in parts]
    return reduce(DataFrame.unionByName, shaped)


def folded(figures: DataFrame) -> DataFrame:
    """The figures of many batches as one row per day and category."""
    sums = [F.sum(c).alias(c) for c in FIGURES.fieldNames()[2:]]
    return figures.groupBy("day", "category").agg(*sums)


def overview_of(figures: DataFrame) -> DataFrame:
    """The overview from figures by day instead of from the tables."""
    names = FIGURES.fieldNames()[2:]
    by_category = figures.groupBy("category").agg(*[F.sum(c).alias(c) for c in names])
    sums = figures.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses", "vectors")])
    rate = sums.select(rate_of(F.col("hits"), F.col("misses")).alias("rate"))
    counted = by_category.select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return figures_of(counted.where((F.col("tickets") > 0) | F.col("category").isNotNull())).select(
        "total_tickets",
        "accuracy",
        "category_distribution",
        "avg_confidence",
        rate.scalar().alias("cache_hit_rate"),
        sums.select("vectors").scalar().alias("vector_store_count"),
    )


def overview_flat(tickets: DataFrame, flagged_requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """The overview with its nested parts as plain columns and one text list."""
    return flat(overview(tickets, flagged_requests, vectors))


def flat(figures: DataFrame) -> DataFrame:
    """An overview with its nested parts as plain columns and one text list."""
    line = F.transform(
        "category_distribution",
        lambda e: F.concat(e["category"], F.lit("="), e["count"].cast("string"), F.lit("="), F.format_number(e["percentage"], 1)),
    )
    return figures.select(
        "total_tickets",
        "accuracy.*",
        F.array_join(line, ";").alias("categories"),
        "avg_confidence",
        "cache_hit_rate",
        "vector_store_count",
    )
