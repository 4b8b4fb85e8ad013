"""Accuracy, distribution, confidence and trend reports.

All ticket figures come from one scan: tickets are first summed by predicted
category (a handful of rows after map-side combine) and the reports are rolled
up from those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskline.constants import CATEGORIES, UNKNOWN_CATEGORY
from deskline.functions.numbers import api_percent, view_percent


def _over_all(value: Column) -> Column:
    """A total next to each row: only ever over rows already summed by category."""
    return value.over(Window.partitionBy())


def _is_correct() -> Column:
    return F.col("predicted_category") == F.col("actual_category")


def totals_by_category(tickets: DataFrame, *by: Column) -> DataFrame:
    """One row per predicted category (null included), and what else is in `by`, with every base figure."""
    return tickets.groupBy(*by, F.col("predicted_category").alias("category")).agg(
        F.count("*").alias("tickets"),
        F.count("actual_category").alias("reviewed"),
        F.count_if(_is_correct()).alias("correct"),
        F.sum("confidence_score").alias("confidence_sum"),
        F.count("confidence_score").alias("confidence_n"),
    )


def accuracy_metrics(tickets: DataFrame) -> DataFrame:
    """Reviewed and correct tickets, accuracy in percent to 2 decimals."""
    counted = tickets.agg(
        F.count("actual_category").alias("total_reviewed"),
        F.count_if(_is_correct()).alias("correct_predictions"),
    )
    return counted.withColumn(
        "accuracy_percentage", view_percent(F.col("correct_predictions"), F.col("total_reviewed"))
    )


def category_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per predicted category, unclassified ones left out."""
    classified = tickets.where(F.col("predicted_category").isNotNull())
    return classified.groupBy(F.col("predicted_category").alias("category")).agg(
        F.count("*").alias("ticket_count")
    )


def category_distribution(tickets: DataFrame) -> DataFrame:
    """Share of each category among classified tickets, largest first."""
    counts = category_counts(tickets)
    whole = _over_all(F.sum("ticket_count"))
    return counts.withColumn("percentage", view_percent(F.col("ticket_count"), whole)).orderBy(
        F.desc("ticket_count"), "category"
    )


def api_distribution(tickets: DataFrame) -> DataFrame:
    """Share of each category among all tickets, unclassified ones included."""
    by_category = totals_by_category(tickets).select("category", F.col("tickets").alias("count"))
    whole = F.greatest(_over_all(F.sum("count")), F.lit(1))
    shared = by_category.withColumn("percentage", api_percent(F.col("count"), whole))
    return shared.where(F.col("category").isNotNull())


def overview_figures(tickets: DataFrame) -> DataFrame:
    """One row with the ticket part of the overview."""
    return figures_of(totals_by_category(tickets))


def figures_of(by_category: DataFrame) -> DataFrame:
    """The ticket part of the overview from base figures, a row per category."""
    shared = by_category.withColumn("whole", F.greatest(_over_all(F.sum("tickets")), F.lit(1)))
    entry = F.struct(
        F.col("category"),
        F.col("tickets").alias("count"),
        api_percent(F.col("tickets"), F.col("whole")).alias("percentage"),
    )
    rolled = shared.agg(
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets"),
        F.coalesce(F.sum("reviewed"), F.lit(0)).alias("total_reviewed"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct_predictions"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.sum("confidence_n").alias("confidence_n"),
        F.sort_array(F.collect_list(F.when(F.col("category").isNotNull(), entry))).alias("category_distribution"),
    )
    mean = F.coalesce(F.try_divide("confidence_sum", F.col("confidence_n").cast("double")), F.lit(0.0))
    return rolled.select(
        "total_tickets",
        F.struct(
            "total_reviewed",
            "correct_predictions",
            api_percent(F.col("correct_predictions"), F.col("total_reviewed")).alias("accuracy_percentage"),
        ).alias("accuracy"),
        "category_distribution",
        F.bround(mean * F.lit(100.0), 1).alias("avg_confidence"),
    )


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Stored vectors per category and in all."""
    category = F.coalesce("category", F.lit(UNKNOWN_CATEGORY))
    counts = vectors.groupBy(category.alias("category")).agg(F.count("*").alias("count"))
    return counts.withColumn("total", _over_all(F.sum("count")))


def accuracy_by_period(tickets: DataFrame, period: str = "week") -> DataFrame:
    """Volume and accuracy per day or (Monday) week of creation."""
    start = F.to_date(F.date_trunc(period, F.col("created_at")))
    counted = tickets.groupBy(start.alias("period_start")).agg(
        F.count("*").alias("tickets"),
        F.count("actual_category").alias("reviewed"),
        F.count_if(_is_correct()).alias("correct"),
    )
    return counted.withColumn("accuracy", api_percent(F.col("correct"), F.col("reviewed")))


def accuracy_trend(tickets: DataFrame, period: str = "week") -> DataFrame:
    """Accuracy per period against the period before: change and direction."""
    in_order = Window.orderBy("period_start")  # one row per period by now
    before = F.lag("accuracy").over(in_order)
    change = F.bround(F.col("current") - F.col("previous"), 1)
    return (
        accuracy_by_period(tickets, period)
        .select("period_start", F.col("accuracy").alias("current"), before.alias("previous"))
        .withColumn("change", change)
        .withColumn(
            "trend",
            F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("stable"),
        )
    )


def feedback_confusion(feedback: DataFrame) -> DataFrame:
    """How often each predicted label was corrected to each new label."""
    return feedback.groupBy("old_label", "new_label").agg(F.count("*").alias("corrections"))


def feedback_matrix(feedback: DataFrame) -> DataFrame:
    """The same counts with one column per new category."""
    counted = feedback.groupBy("old_label").pivot("new_label", CATEGORIES).agg(F.count(F.lit(1)))
    return counted.na.fill(0, CATEGORIES)
