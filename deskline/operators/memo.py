"""The memo of earlier results: a fixed time to live, in batch.

An entry lives for exactly `ttl` seconds from the moment it was written and is
not refreshed by reads: at written_at + ttl it is gone.  So per key a request
is a miss (and writes an entry) when the last miss is at least `ttl` old, and a
hit otherwise.

Requests are laid out by range of (key, time, id).  A key that lies inside one
task is folded there, from miss to miss.  A task's first and last key may go on
next door, so their rows come out as pieces.  Of a piece only those rows matter
that can be the first miss in it; from each of them the misses inside the piece
are fixed, up to a last one, and so is the next miss after the piece.  That gives
each such row one pointer, to a row of a later piece.  Which of them are
reached from the key's first miss is found by doubling the pointers: the number
of joins is the logarithm of the number of pieces, whatever the time span and
the lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskline.constants import MEMO_TTL_SECONDS
from deskline.operators.asof import key_changes, last_entries
from deskline.session import cut


def micros(ts: Column) -> Column:
    """A timestamp as microseconds (wall clock in the session zone, UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def _chain(us: np.ndarray, start: int, span: int) -> list[int]:
    """The places of the misses among sorted times, the first one at `start`."""
    out = []
    while start < len(us):
        out.append(start)
        start = int(np.searchsorted(us, us[start] + span))
    return out


def _folded(batches: Iterator[pa.RecordBatch], span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task with `hit`; rows of its first and last key with `piece` instead.

    A row with a null request_id is the entry from before the batch, and comes first in its key.
    """
    piece = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []  # rows of the key that is not over
    first = True

    def given(rows: pa.RecordBatch, hit: np.ndarray | None) -> pa.RecordBatch:
        flags = pa.nulls(len(rows), pa.bool_()) if hit is None else pa.array(hit)
        place = pa.array(np.full(len(rows), piece, np.int32), mask=np.full(len(rows), hit is not None))
        return pa.RecordBatch.from_arrays([*[rows.column(n) for n in ("request_id", "key", "ts", "us", "last")], flags, place], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        start = np.flatnonzero(key_changes(rows.column("key")))
        if len(start) == 1:
            held = [rows]
            continue
        if first:
            yield given(rows.slice(0, int(start[1])), None)
            start, first = start[1:], False
        low, high = int(start[0]), int(start[-1])
        if low < high:
            done = rows.slice(low, high - low)
            yield given(done, _hits(done, start - low, span))
        held = [rows.slice(high)]
    if held:
        yield given(pa.Table.from_batches(held).combine_chunks().to_batches()[0], None)


def _hits(rows: pa.RecordBatch, start: np.ndarray, span: int) -> np.ndarray:
    us = rows.column("us").to_numpy()
    last = rows.column("last")
    with_last = last.is_valid().to_numpy(zero_copy_only=False)
    hit = np.ones(len(us), bool)
    # Most keys: requests that follow each other within a lifetime, all hits but the first.
    size = np.diff(start)
    short = us[start[1:] - 1] - us[start[:-1]] < span
    plain = short & ~with_last[start[:-1]]
    hit[start[:-1][plain]] = False
    for k in np.flatnonzero(~plain):
        i, n = int(start[k]), int(size[k])
        skip = int(with_last[i])
        own = us[i + skip : i + n]
        at = int(np.searchsorted(own, last[i].as_py() + span)) if skip else 0
        hit[[i + skip + j for j in _chain(own, at, span)]] = False
    return hit


def _pieces(table: pa.Table, span: int, schema: pa.Schema) -> pa.Table:
    """The rows of a piece that can be its first miss, with the time from which on the next miss after the piece may come."""
    table = table.sort_by([("us", "ascending"), ("request_id", "ascending")])
    us = table["us"].to_numpy()
    n = int(np.searchsorted(us, us[0] + span)) + 1
    # The last miss in the piece, from each row on: that of the row's next miss, if it is in the piece.
    after = np.searchsorted(us, us + span)
    last = np.arange(len(us) + 1)
    inside = np.flatnonzero(after < len(us))
    last[inside] = after[inside]
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    some = table.slice(0, n)
    out = {"key": some["key"], "us": some["us"], "request_id": some["request_id"], "due": pa.array(us[last[: len(some)]] + span)}
    return pa.table([out[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


def _reached(table: pa.Table, span: int, schema: pa.Schema) -> pa.Table:
    """The rows of a piece with `hit`; the row marked `entry` is the piece's first miss, without one there is none."""
    table = table.sort_by([("us", "ascending"), ("request_id", "ascending")])
    hit = np.ones(table.num_rows, bool)
    entry = np.flatnonzero(table["entry"].to_numpy(zero_copy_only=False))
    if len(entry):
        hit[_chain(table["us"].to_numpy(), int(entry[0]), span)] = False
    return pa.table([table["request_id"], table["key"], table["ts"], pa.array(hit)], schema=schema)


def _flagged(requests: DataFrame, span: int, prior: DataFrame | None, partitions: int | None) -> DataFrame:
    """`request_id, key, ts, hit` of every request."""
    rows = requests.select("request_id", "key", "ts", micros(F.col("ts")).alias("us"), F.lit(None).cast("bigint").alias("last"))
    if prior is not None:
        last = prior.groupBy("key").agg(F.max(micros(F.col("written_at"))).alias("last"))
        empty = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in ("request_id", "ts")]
        rows = rows.unionByName(last.select(empty[0], "key", empty[1], F.lit(-(1 << 62)).alias("us"), "last"))
    place = [F.asc_nulls_first(c) for c in ("key", "us", "request_id")]
    laid = rows.repartitionByRange(partitions, *place) if partitions else rows.repartitionByRange(*place)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).add("hit", "boolean").add("piece", "integer")
    arrow = to_arrow_schema(schema)
    found = cut(laid.sortWithinPartitions(*place).mapInArrow(lambda b: _folded(b, span, arrow), schema), "memo")
    columns = ["request_id", "key", "ts", "hit"]
    whole = found.where(F.col("piece").isNull() & F.col("request_id").isNotNull()).select(*columns)
    return whole.unionByName(_over_pieces(found.where(F.col("piece").isNotNull()), span).select(*columns))


def _over_pieces(rows: DataFrame, span: int) -> DataFrame:
    """`hit` of the rows of keys that may lie over several tasks."""
    # At most two keys per task, so the table of their starts has a bounded size.
    starts = rows.where(F.col("last").isNotNull()).select(F.struct("key").alias("of"), (F.col("last") + F.lit(span)).alias("from"))
    asked = rows.where(F.col("last").isNull()).withColumn("of", F.struct("key"))
    asked = asked.join(F.broadcast(starts), "of", "left").drop("of")
    covered = F.coalesce(F.col("us") < F.col("from"), F.lit(False))
    early = asked.where(covered).withColumn("hit", F.lit(True))
    late = asked.where(~covered)
    node = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select("key", "us", "request_id").schema]).add("due", "long")
    arrow = to_arrow_schema(node)
    nodes = late.groupBy("key", "piece").applyInArrow(lambda t: _pieces(t, span, arrow), node)
    nodes = cut(nodes, "nodes")
    reached = _followed(nodes).select(F.struct("key", "us", "request_id").alias("id"), F.lit(True).alias("entry"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select("request_id", "key", "ts").schema]).add("hit", "boolean")
    flags = to_arrow_schema(out)
    marked = late.withColumn("id", F.struct("key", "us", "request_id")).join(reached, "id", "left")
    marked = marked.withColumn("entry", F.coalesce("entry", F.lit(False))).drop("id")
    return marked.groupBy("key", "piece").applyInArrow(lambda t: _reached(t, span, flags), out).unionByName(early.select(*out.names))


def _followed(nodes: DataFrame) -> DataFrame:
    """The nodes reached from the first one of each key; a node points to the first one of its key from `due` on."""
    this = F.struct("key", "us", "request_id").alias("id")
    # The first node at or after a time is the last one before it when time runs backwards.
    asked = nodes.select("key", (-F.col("due")).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(nodes.schema["request_id"].dataType).alias("r"), this)
    back = nodes.select("key", (-F.col("us")).alias("t"), F.lit(0).alias("side"), F.col("request_id").alias("r"), this)
    # Of nodes of one time the smallest id counts: it has to come last.
    least = back.groupBy("key", "t", "side").agg(F.min("id").alias("entry"))
    jumps = last_entries(asked.withColumnRenamed("id", "request"), least, ["t", "side"]).select(
        F.col("request").alias("id"), F.col("entry").alias("to")
    )
    first = nodes.groupBy("key").agg(F.min(F.struct("us", "request_id")).alias("f"))
    reached = first.select(F.struct("key", "f.us", "f.request_id").alias("id"))
    while not (open_ := jumps.where(F.col("to").isNotNull())).isEmpty():
        onward = reached.join(open_, "id").select(F.col("to").alias("id"))
        reached = cut(reached.unionByName(onward).distinct(), "reached")
        # Pointers twice as long.
        then = jumps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        jumps = cut(open_.join(then, "to").select("id", F.col("further").alias("to")).where(F.col("to").isNotNull()), "jumps")
    return reached.select("id.*")


def misses(
    requests: DataFrame, ttl: int = MEMO_TTL_SECONDS, prior: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """The requests that miss and so write an entry: `key, ts, request_id`.

    `requests` has `request_id, key, ts`; request_id is unique and at equal times the
    lower one comes first.  `prior` (`key, written_at`) holds entries from before the
    batch.  Null is a key.  `partitions` says over how many ranges the rows are laid.
    """
    found = _flagged(requests.select("request_id", "key", "ts"), ttl * 1_000_000, prior, partitions)
    return found.where(~F.col("hit")).select("key", "ts", "request_id")


def with_hits(
    requests: DataFrame, ttl: int = MEMO_TTL_SECONDS, prior: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Every request with `hit`: false where it misses.

    Where there are more columns than `request_id, key, ts` the flag comes back by
    request id, which is unique: that join is even however uneven the keys are.
    """
    if set(requests.columns) == {"request_id", "key", "ts"}:
        return _flagged(requests, ttl * 1_000_000, prior, partitions).select(*requests.columns, "hit")
    flags = misses(requests, ttl, prior, partitions).select("request_id", F.lit(False).alias("_hit"))
    flagged = requests.join(flags, "request_id", "left")
    return flagged.select(*[flagged[c] for c in requests.columns], F.coalesce("_hit", F.lit(True)).alias("hit"))


def looked_up(requests: DataFrame, entries: DataFrame, ttl: int = MEMO_TTL_SECONDS, partitions: int | None = None) -> DataFrame:
    """Every request with the live entry it finds: `written_at, result`, or nulls.

    `requests` has `request_id, key, ts`; `entries` has `key, written_at,
    result` and may have `entry_id`, the request that wrote it (an entry is seen
    by requests after that one; without an id also at its very instant).
    At one instant come entries without id, then by id, a request before the entry it wrote.
    """
    id_type = requests.schema["request_id"].dataType
    entry_id = F.col("entry_id").cast(id_type) if "entry_id" in entries.columns else F.lit(None).cast(id_type)
    written = entries.select(
        "key", micros(F.col("written_at")).alias("us"), entry_id.alias("id"), F.struct("written_at", "result").alias("entry")
    )
    asked = requests.select(
        "key", micros(F.col("ts")).alias("us"), F.col("request_id").alias("id"),
        F.struct(*[c for c in requests.columns if c != "key"]).alias("request"),
    )
    found = last_entries(asked, written, ["us", "id"], partitions)
    alive = micros(F.col("request.ts")) < micros(F.col("entry.written_at")) + F.lit(ttl * 1_000_000)
    entry = F.when(alive, F.col("entry"))
    return found.select(
        F.col("request.request_id").alias("request_id"), "key", "request.ts",
        *[F.col("request")[c].alias(c) for c in requests.columns if c not in ("request_id", "key", "ts")],
        entry["written_at"].alias("written_at"), entry["result"].alias("result"), F.coalesce(alive, F.lit(False)).alias("hit"),
    )


def live_entries(entries: DataFrame, at: Column, ttl: int = MEMO_TTL_SECONDS) -> DataFrame:
    """Per key the last entry written by `at`, where it is still alive then."""
    last_first = Window.partitionBy("key").orderBy(F.desc("written_at"))
    known = entries.where(F.col("written_at") <= at)
    last = known.withColumn("_rank", F.row_number().over(last_first)).where("_rank = 1").drop("_rank")
    return last.where(micros(at) - micros(F.col("written_at")) < F.lit(ttl * 1_000_000))


def invalidated(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries without those of the given keys."""
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def new_entries(results: DataFrame, key: str = "memo_key", at: str = "ts", result: str = "result") -> DataFrame:
    """Memo rows to append for results that may be remembered."""
    return results.select(F.col(key).alias("key"), F.col(at).alias("written_at"), F.col(result).alias("result"))


def hit_rate(flagged: DataFrame) -> DataFrame:
    """One row: hits, misses and the hit rate in percent (1 decimal)."""
    counted = flagged.agg(
        F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
    return counted.withColumn("hit_rate", rate_of(F.col("hits"), F.col("misses")))


def rate_of(hits: Column, misses: Column) -> Column:
    """The hit rate in percent (1 decimal); 0 without requests."""
    share = F.try_divide(hits.cast("double"), (hits + misses).cast("double"))
    return F.coalesce(F.bround(share * 100.0, 1), F.lit(0.0))


def cache_stats(flagged: DataFrame, entries: DataFrame, at: Column, ttl: int = MEMO_TTL_SECONDS) -> DataFrame:
    """The hit rate together with the number of entries alive at `at`."""
    alive = live_entries(entries, at, ttl).agg(F.count("*").alias("n"))
    return hit_rate(flagged).withColumn("keys", alive.scalar())


def as_text(entries: DataFrame) -> DataFrame:
    """Entries with the result as JSON text, for stores that keep plain text."""
    return entries.withColumn("result", F.to_json("result"))


def from_text(entries: DataFrame, schema: T.StructType) -> DataFrame:
    """Entries read back from JSON text."""
    return entries.withColumn("result", F.from_json("result", schema))
