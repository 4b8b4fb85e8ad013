"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is frequent when it holds more than 1 / FREQUENT_SHARE of the rows.
# There can never be more than FREQUENT_SHARE such keys, whatever the data.
FREQUENT_SHARE = 1024


def frequent_keys(df: DataFrame, key: str, share: int = FREQUENT_SHARE) -> list:
    """The keys that hold more than 1/share of all rows: at most `share` values.

    None is among them when that many rows have no key.  One mergeable sketch
    per task, one row to the driver.  The sketch may miss or add a borderline
    key; that moves work around and changes no result.
    """
    found = (
        df.agg(
            F.count("*").alias("n"),
            F.count_if(F.col(key).isNull()).alias("nulls"),
            F.expr(f"approx_top_k(`{key}`, {share}, {share * 32})").alias("top"),
        )
        .select("n", "nulls", F.filter("top", lambda e: e["count"] * share > F.col("n")).alias("top"))
        .first()
    )
    keys = [entry["item"] for entry in found["top"] or [] if entry["item"] is not None]
    return keys + [None] if found["nulls"] * share > found["n"] else keys


# At most this many rows are broadcast on request; larger inputs are shuffled.
BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def join_on_key(
    many: DataFrame, one: DataFrame, key: str, how: str, frequent: list | None = None
) -> DataFrame:
    """`many` joined to `one` (one row per key at most), even under heavy keys.

    Rows of frequent keys never travel: their few partner rows (one per key, so
    at most FREQUENT_SHARE) are broadcast.  All other rows take the normal
    shuffle join.  Without frequent keys this is just the normal join.
    """
    frequent = frequent_keys(many, key) if frequent is None else frequent
    if not frequent:
        return many.join(one, key, how)
    heavy = F.coalesce(F.col(key).isin([k for k in frequent if k is not None]), F.lit(None in frequent))
    rest = many.where(~heavy).join(one.where(~heavy), key, how)
    held = many.where(heavy).join(F.broadcast(one.where(heavy & F.col(key).isNotNull())), key, how)
    return rest.unionByName(held)
