"""As-of lookups that stay even however uneven the keys are.

Rows of both sides are laid out by range of (key, time, ...): a key with most of
the rows lies over many tasks.  Each task fills the last entry forward over its
sorted rows.  What a task cannot know is the last entry of its first key from the
tasks before it; every task hands on its last key and that key's last entry, one
row each, and the rows left open take theirs from that small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskline.session import cut


def key_changes(keys: pa.Array) -> np.ndarray:
    """For sorted keys: whether each row's key differs from the one before it (True for the first); nulls are equal."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    change = np.ones(len(keys), bool)
    if len(keys) > 1:
        here, before = keys[1:], keys[:-1]
        differs = pc.fill_null(pc.not_equal(here, before), pc.xor(here.is_null(), before.is_null()))
        change[1:] = differs.to_numpy(zero_copy_only=False)
    return change


def _filled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task -> its requests with the last entry before them, and a row for what it hands on.

    `piece` is set where the entry may lie in an earlier task, and in the row that is handed on.
    """
    piece = TaskContext.get().partitionId()
    carried: pa.RecordBatch | None = None  # the last row so far, with its entry filled in
    in_first = True  # whether all rows so far have the task's first key
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        change = key_changes(rows.column("key"))
        run = np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))
        filled = rows.column("entry").is_valid().to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(filled, np.arange(len(filled)), -1))
        known = last >= run
        entry = rows.column("entry").take(pa.array(np.where(known, last, 0), mask=~known))
        is_request = rows.column("request").is_valid().to_numpy(zero_copy_only=False)
        if carried is not None:
            is_request[0] = False  # given out with its own batch
        asked = np.flatnonzero(is_request)
        if len(asked):
            elsewhere = ~known[asked] & (run[asked] == 0) & in_first
            where = pa.array(np.full(len(asked), piece, np.int32), mask=~elsewhere)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(asked)) for c in (rows.column("key"), rows.column("request"), entry)] + [where], schema=schema)
        in_first = in_first and int(run[-1]) == 0
        end = len(change) - 1
        carried = pa.RecordBatch.from_arrays([entry[end:] if n == "entry" else rows.column(n)[end:] for n in rows.schema.names], schema=rows.schema)
    if carried is not None:
        handed = [carried.column("key"), pa.nulls(1, schema.field("request").type), carried.column("entry"), pa.array([piece], pa.int32())]
        yield pa.RecordBatch.from_arrays(handed, schema=schema)


def last_entries(asked: DataFrame, written: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Every request with the last entry of its key before it: `key, request, entry` (null without any).

    asked:   `key`, the columns of `order`, and a struct `request`.
    written: `key`, the columns of `order`, and a struct `entry`.
    Rows are ordered by the columns of `order` (ascending, nulls first) within a
    key; of rows equal in all of them requests come first.  Null is a key.
    """
    no_entry = F.lit(None).cast(written.schema["entry"].dataType)
    no_request = F.lit(None).cast(asked.schema["request"].dataType)
    rows = asked.select("key", *order, F.col("request"), no_entry.alias("entry")).unionByName(
        written.select("key", *order, no_request.alias("request"), F.col("entry"))
    )
    place = [F.asc_nulls_first(c) for c in ("key", *order)]
    laid = rows.repartitionByRange(partitions, *place) if partitions else rows.repartitionByRange(*place)
    laid = laid.sortWithinPartitions(*place, F.col("entry").isNotNull()).select("key", "request", "entry")
    schema = T.StructType([laid.schema["key"], asked.schema["request"], written.schema["entry"]]).add("piece", "integer")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow = to_arrow_schema(schema)
    found = cut(laid.mapInArrow(lambda b: _filled(b, arrow), schema), "asof")
    requests = found.where(F.col("request").isNotNull())
    # One row per task, whatever the data.
    handed = found.where(F.col("request").isNull() & F.col("entry").isNotNull())
    handed = handed.select(F.struct("key").alias("of"), F.col("piece").alias("from"), F.col("entry").alias("handed"))
    firsts = requests.where(F.col("piece").isNotNull()).select(F.struct("key").alias("of"), "piece").distinct()
    before = firsts.join(F.broadcast(handed), "of").where(F.col("from") < F.col("piece"))
    latest = before.groupBy("piece").agg(F.max_by("handed", "from").alias("handed"))
    joined = requests.join(F.broadcast(latest), "piece", "left")
    return joined.select("key", "request", F.coalesce("entry", "handed").alias("entry"))
