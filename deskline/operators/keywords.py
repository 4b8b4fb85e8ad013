"""The keyword classifier.

The word lists are configuration, so they are unrolled into plain `contains`
expressions: no join, no shuffle, one pass over each text inside codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import CATEGORIES, KEYWORD_REASONING, KEYWORDS, MAX_INDICATORS

Rules = Mapping[str, Sequence[str]]


def category_dimension(spark) -> DataFrame:
    """The fixed categories with their position and how many there are."""
    rows = [(i, name, len(CATEGORIES)) for i, name in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, category string, category_count int")


def matched_words(lowered: Column, words: Sequence[str]) -> Column:
    """The words found anywhere inside the text, in list order, each once."""
    hits = F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words])
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def classify_by_keywords(df: DataFrame, text: str, rules: Rules = KEYWORDS) -> DataFrame:
    """Adds kw_category, kw_confidence, kw_reasoning and kw_indicators.

    Most matched words wins, ties and the no-match case go to the category
    listed first.  Confidence grows with the winner's share of all matches.
    """
    kept = df.columns
    names = list(rules)
    found = df.withColumn("_lowered", F.lower(text)).withColumns(
        {f"_found{i}": matched_words(F.col("_lowered"), rules[name]) for i, name in enumerate(names)}
    )
    sized = found.withColumns({f"_n{i}": F.size(f"_found{i}") for i in range(len(names))})
    counts = [F.col(f"_n{i}") for i in range(len(names))]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    total = sum(counts[1:], counts[0])

    def of_winner(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(n == F.col("_best"), v) for n, v in zip(counts, values)])

    scored = sized.withColumns({"_best": best, "_total": total})
    confidence = F.when(
        F.col("_total") > 0,
        F.least(
            F.lit(0.4) + F.try_divide(F.col("_best").cast("double"), F.col("_total").cast("double")) * F.lit(0.4),
            F.lit(0.7),
        ),
    ).otherwise(F.lit(0.3))
    return scored.select(
        *kept,
        of_winner([F.lit(name) for name in names]).alias("kw_category"),
        F.round(confidence, 2).alias("kw_confidence"),
        F.lit(KEYWORD_REASONING).alias("kw_reasoning"),
        F.slice(of_winner([F.col(f"_found{i}") for i in range(len(names))]), 1, MAX_INDICATORS).alias(
            "kw_indicators"
        ),
    )
