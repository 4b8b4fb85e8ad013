"""Structured Streaming jobs.

Every job takes a streaming DataFrame, an output folder and a checkpoint folder,
runs until its source is drained (`available_now`) or for ever, and writes
files named after the micro-batch, so a repeated batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from deskline.constants import KEYWORDS, MEMO_TTL_SECONDS
from deskline.operators.corrections import as_corrections, corrected_tickets, feedback_rows
from deskline.operators.intake import accepted, with_texts
from deskline.operators.keywords import classify_by_keywords
from deskline.operators.memo import with_hits
from deskline.plans import store as store_plan
from deskline.session import cut
from deskline.sources.store import Store
from deskline.sources.tables import status_of


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool
) -> StreamingQuery:
    return _started(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, available_now)


def intake(
    tickets: DataFrame,
    out: str,
    checkpoint: str,
    rules: Mapping[str, Sequence[str]] = KEYWORDS,
    available_now: bool = True,
) -> StreamingQuery:
    """Accept, classify by keywords and append.  Stateless: no shuffle at all."""
    rows = classify_by_keywords(with_texts(accepted(tickets)), "full_text", rules).withColumn(
        "status", status_of(F.col("kw_category"))
    )
    return _started(rows.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, available_now)


def store_tickets(
    tickets: DataFrame, store: Store, checkpoint: str, answers: DataFrame | None = None, available_now: bool = True, **options
) -> StreamingQuery:
    """Check, classify and store tickets batch by batch: tickets, vectors, memo and refused ones, all or nothing.

    The micro-batch's number is the store's, so a repeated one replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store_plan.store_tickets(store, batch_id, cut(batch, "batch"), answers, **options)

    return _each_batch(tickets, write, checkpoint, "append", available_now)


def store_corrections(
    tickets: DataFrame, feed: DataFrame, store: Store, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Classified tickets and their corrections, two streams into one store.

    A correction may come before its ticket: it waits in the store until it does.
    Refused corrections go to a table of their own.  Tickets are not rewritten:
    the log is applied when they are read.
    """
    ticket, correction = (F.struct(*[F.col(c) for c in df.columns]) for df in (tickets, feed))
    both = tickets.select(ticket.alias("ticket"), F.lit(None).cast(feed.select(correction).schema[0].dataType).alias("correction"))
    both = both.unionByName(feed.select(F.lit(None).cast(both.schema["ticket"].dataType).alias("ticket"), correction.alias("correction")))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch, "batch")
        came = rows.where(F.col("ticket").isNotNull()).select("ticket.*")
        store_plan.store_corrections(store, batch_id, rows.where(F.col("correction").isNotNull()).select("correction.*"), came)

    return _each_batch(both, write, checkpoint, "append", available_now)


def corrections(
    feed: DataFrame, tickets: DataFrame, log: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Log the valid corrections of tickets that are all known beforehand, batch by batch.

    The tickets table is not rewritten per micro-batch: `current_tickets` applies
    the log when it is read.  `store_corrections` is the job for tickets that come in meanwhile.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        feedback_rows(tickets, cut(batch, "batch")).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return _each_batch(feed, write, checkpoint, "append", available_now)


def current_tickets(tickets: DataFrame, log: DataFrame) -> DataFrame:
    """Tickets with every logged correction applied, the latest winning."""
    return corrected_tickets(tickets, as_corrections(log))


def memo(
    requests: DataFrame, out: str, checkpoint: str, ttl: int = MEMO_TTL_SECONDS, available_now: bool = True
) -> StreamingQuery:
    """Hit or miss of every request, `request_id, key, ts, hit`, below `out`/hits.

    The state is one row per key whose entry is still alive, written anew below
    `out`/alive with each micro-batch; a batch reads the state of the one before
    and nothing older.  The batch itself is the batch operator, so a heavy key is
    spread over tasks; keyed operator state would put its rows through one.
    Requests have to come in time order, from batch to batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.select("request_id", "key", "ts"), "batch")
        state = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("written_at", rows.schema["ts"].dataType)])
        prior = spark.read.schema(state).parquet(f"{out}/alive/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], state)
        hits = f"{out}/hits/batch={batch_id}"
        with_hits(rows, ttl, prior).write.mode("overwrite").parquet(hits)
        flagged = spark.read.schema(rows.schema.add("hit", "boolean")).parquet(hits)
        entries = prior.unionByName(flagged.where("not hit").select("key", F.col("ts").alias("written_at")))
        last = entries.groupBy("key").agg(F.max("written_at").alias("written_at"))
        # Later requests are not before this batch's last one: what is gone by then is forgotten.
        now = rows.agg(F.max("ts")).scalar()
        alive = F.col("written_at") > now - F.make_dt_interval(secs=F.lit(ttl))
        last.where(alive | now.isNull()).write.mode("overwrite").parquet(f"{out}/alive/batch={batch_id}")

    return _each_batch(requests, write, checkpoint, "append", available_now)


def first_seen(
    requests: DataFrame, out: str, checkpoint: str, window: str = "7 days", delay: str = "7 days", available_now: bool = True
) -> StreamingQuery:
    """The first request of each key in each fixed window of event time, kept up to date.

    A window's answer is a minimum, so it does not depend on how the requests are
    dealt out to files and batches as long as none is later than `delay`; a heavy
    key sends one row per task and window.  Read with `first_seen_now`.
    """
    slot = F.window("ts", window)
    first = requests.withWatermark("ts", delay).groupBy("key", slot).agg(F.min("ts").alias("ts"))
    return _each_batch(first.select("key", F.col("window.start").alias("period_start"), "ts"), _write_versions(out), checkpoint, "update", available_now)


def first_seen_now(spark: SparkSession, out: str) -> DataFrame:
    """`key, period_start, ts` of all windows so far; a batch only has the windows it changed."""
    return spark.read.parquet(out).groupBy("key", "period_start").agg(F.min("ts").alias("ts"))


def _write_versions(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={batch_id}")

    return write


def latest_version(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete result below `out`."""
    every = spark.read.parquet(out)
    newest = every.agg(F.max("v").alias("v"))
    return every.where(F.col("v") == newest.scalar()).drop("v")


def accuracy_windows(
    tickets: DataFrame,
    out: str,
    checkpoint: str,
    days: int = 7,
    delay: str = "40 days",
    mode: str = "complete",
    available_now: bool = True,
) -> StreamingQuery:
    """Volume and accuracy per day or Monday week, kept up to date.

    Mode complete writes all windows each time (read with `latest_version`),
    update the changed ones, append each window once, when the watermark has
    passed its end.  Epoch day 0 is a Thursday: weeks start 4 days later.
    """
    start = "4 days" if days == 7 else "0 days"
    window = F.window("created_at", f"{days} days", f"{days} days", start)
    counted = (
        tickets.withWatermark("created_at", delay)
        .groupBy(window)
        .agg(
            F.count("*").alias("tickets"),
            F.count("actual_category").alias("reviewed"),
            F.count_if(F.col("predicted_category") == F.col("actual_category")).alias("correct"),
        )
        .select(F.to_date("window.start").alias("period_start"), "tickets", "reviewed", "correct")
    )
    return _each_batch(counted, _write_versions(out), checkpoint, mode, available_now)


def running_totals(tickets: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Tickets and mean confidence per predicted category, kept up to date."""
    counted = tickets.groupBy(F.col("predicted_category").alias("category")).agg(
        F.count("*").alias("tickets"), F.avg("confidence_score").alias("mean_confidence")
    )
    return _each_batch(counted, _write_versions(out), checkpoint, "complete", available_now)
