"""Reading and writing the stores as plain parquet tables.

Tables that are filled once are appended to below a day partition, so date
filters prune files; appending again appends again.  A changed table is written
as a new version beside the old one: a path is never overwritten while it is
read, and writing a version again replaces only it.  Jobs that have to be
repeatable, or write several tables together, use `sources.store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.constants import STATUS_CLASSIFIED, STATUS_OPEN
from deskline.functions.text import is_filled, stored_title
from deskline.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Batch scan with a declared schema; filters and columns are pushed down."""
    return spark.read.schema(schema).parquet(path)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TICKETS)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FEEDBACK)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.VECTORS)


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.MEMO)


def read_answers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw model answers, one per ticket, from parquet or JSON lines."""
    return spark.read.schema(schemas.ANSWERS).format(fmt).load(path)


def status_of(category: Column) -> Column:
    """A ticket with a category is classified, without one it is open."""
    return F.when(is_filled(category), STATUS_CLASSIFIED).otherwise(STATUS_OPEN)


def new_ticket_rows(
    classified: DataFrame, ticket_id: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Rows for the tickets table from `title, description, category, confidence, reasoning`.

    id and clock default to a fresh uuid and the current time; a job that has
    to be repeatable passes its own.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    ticket_id = F.uuid() if ticket_id is None else ticket_id
    return classified.select(
        ticket_id.alias("id"),
        stored_title(F.col("title"), F.col("description")).alias("title"),
        "description",
        F.col("category").alias("predicted_category"),
        F.lit(None).cast("string").alias("actual_category"),
        F.col("confidence").alias("confidence_score"),
        "reasoning",
        status_of(F.col("category")).alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def append(rows: DataFrame, path: str, day_of: str | None = "created_at") -> None:
    """Append, partitioned by the day of `day_of` (None: no partitioning)."""
    if day_of is None:
        rows.write.mode("append").parquet(path)
        return
    # One task per day: a day's rows of a batch are one file.
    rows.withColumn("day", F.to_date(day_of)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def write_version(rows: DataFrame, path: str, version: int) -> str:
    """Write one version of a changed table; writing it again replaces only it."""
    target = f"{path.rstrip('/')}/v={version}"
    rows.write.mode("overwrite").parquet(target)
    return target
