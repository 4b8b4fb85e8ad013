"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TICKETS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("predicted_category", T.StringType()),
        T.StructField("actual_category", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("ticket_id", T.StringType(), False),
        T.StructField("old_label", T.StringType()),
        T.StructField("new_label", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

CORRECTIONS = T.StructType(
    [
        T.StructField("correction_id", T.StringType(), False),
        T.StructField("ticket_id", T.StringType(), False),
        T.StructField("corrected_category", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("corrected_at", T.TimestampNTZType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

ANSWERS = T.StructType(
    [T.StructField("ticket_id", T.StringType(), False), T.StructField("raw", T.StringType())]
)

NEIGHBOUR_REF = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("key_indicators", T.ArrayType(T.StringType())),
        T.StructField("similar_tickets", T.ArrayType(NEIGHBOUR_REF)),
    ]
)

MEMO = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("written_at", T.TimestampNTZType(), False),
        T.StructField("result", RESULT),
    ]
)

# ---- the store: the tables above as they are written, batch by batch ---------------

# An update of a vector: the row that counts from `batch` on; a deleted one has only its id.
VECTOR_UPDATES = T.StructType(VECTORS.fields + [T.StructField("deleted", T.BooleanType()), T.StructField("batch", T.LongType())])

# Tickets and corrections that were not taken, as they came in, with the reason.
REFUSED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("problem", T.StringType()),
    ]
)

# What batches add to the overview, by day and category.
FIGURES = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("tickets", T.LongType()),
        T.StructField("reviewed", T.LongType()),
        T.StructField("correct", T.LongType()),
        T.StructField("confidence_sum", T.DoubleType()),
        T.StructField("confidence_n", T.LongType()),
        T.StructField("hits", T.LongType()),
        T.StructField("misses", T.LongType()),
        T.StructField("vectors", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("files", T.MapType(T.StringType(), T.StringType())),
    ]
)

# What a vector index consists of: its pivots, and for each batch of the store the folders made from it.
INDEX_MANIFEST = T.StructType(
    [
        T.StructField("attempt", T.LongType()),
        T.StructField(
            "generation",
            T.StructType(
                [
                    T.StructField("folder", T.StringType()),
                    T.StructField("length", T.IntegerType()),
                    T.StructField("rows", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "parts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("batch", T.LongType()),
                        T.StructField("source", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("rows", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
