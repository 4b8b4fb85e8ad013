"""The vector table: upsert, delete, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskline.constants import EXAMPLES_PER_CATEGORY


def with_category(metadata: Column | None, category: Column) -> Column:
    """Metadata with the category added; the caller's own keys win."""
    base = F.when(category.isNotNull(), F.create_map(F.lit("category"), category)).otherwise(
        F.create_map().cast("map<string,string>")
    )
    if metadata is None:
        return base
    own = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    missing = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(missing, own)


def vector_rows(df: DataFrame, metadata: str | None = None) -> DataFrame:
    """Vector table rows from `id, document, category, embedding`, own metadata and `created_at`.

    The time is what later batches' as-of searches go by; it is null where df has none.
    """
    merged = with_category(F.col(metadata) if metadata else None, F.col("category"))
    at = F.col("created_at") if "created_at" in df.columns else F.lit(None)
    return df.select("id", "document", "embedding", merged.alias("metadata"), at.cast("timestamp_ntz").alias("created_at")).select(
        "id", "document", F.col("metadata")["category"].alias("category"), "metadata", "embedding", "created_at"
    )


def upserted(vectors: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """One row per id: the update with the highest `order`, else the old row.

    Of updates with the same `order` the one with the larger content hash wins,
    so the result does not depend on how the updates are split.

    Only the updates are ranked (row_number = 1 is pushed below their shuffle);
    the table itself loses the replaced ids by an anti join, which for a small
    batch of updates is a broadcast and leaves the table where it is.
    """
    columns = vectors.columns
    newest = Window.partitionBy("id").orderBy(F.desc(order), F.desc(F.xxhash64("document", "category", "embedding")))
    last = updates.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(*columns)
    return without_ids(vectors, last).unionByName(last)


def without_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors whose id is not among `ids`."""
    return vectors.join(ids.select("id"), "id", "left_anti")


def category_examples(
    vectors: DataFrame, category: str | None = None, n: int = EXAMPLES_PER_CATEGORY
) -> DataFrame:
    """The first n documents of one category, or of every category."""
    if category is not None:
        chosen = vectors.where(F.col("category") == category).select("category", "id", "document")
        return chosen.orderBy("id").limit(n)
    by_id = Window.partitionBy("category").orderBy("id")
    ranked = vectors.where(F.col("category").isNotNull()).withColumn("_rank", F.row_number().over(by_id))
    return ranked.where(F.col("_rank") <= n).select("category", "id", "document")
