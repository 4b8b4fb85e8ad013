"""Every registered query: the library applied to the derived ticket data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskline.constants import CATEGORIES, CONTEXT_NEIGHBOURS
from deskline.functions.answers import answer_fields, fields_of, parsed
from deskline.operators import analytics, corrections, intake, keywords, listing, memo, similar, vectors
from deskline.plans import classify as classify_plan
from deskline.plans import store as store_plan
from deskline.plans.overview import day_figures, flat, folded, overview_flat, overview_of
from deskline.session import cut, work_dir
from deskline.sources.store import Store
from deskline.sources.tables import append, status_of
from deskline.sources.vector_index import VectorIndex
from deskline.streaming import jobs
from registered.views import INTAKE, LANGUAGE_RULES, TICKETS, Given

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}

LOOKUP_ID = 42
PAGE, LIMIT, STATUS, CATEGORY = 3, 20, "corrected", "Network Issue"
DEEP_LIMIT = 50
ALIVE_AT = "2024-01-20 00:00:00"


def query(build: Callable[[Given], DataFrame]) -> Callable[[Given], DataFrame]:
    """Registers a function of the given tables under its own name."""
    _registered[build.__name__] = lambda spark, folder: build(Given(spark, folder))
    return build


def all_queries() -> dict[str, Query]:
    return dict(_registered)


# ---- reports -----------------------------------------------------------------


@query
def accuracy_metrics(given: Given) -> DataFrame:
    return analytics.accuracy_metrics(given.tickets())


@query
def category_distribution(given: Given) -> DataFrame:
    return analytics.category_distribution(given.tickets())


@query
def category_counts(given: Given) -> DataFrame:
    return analytics.category_counts(given.tickets())


@query
def api_distribution(given: Given) -> DataFrame:
    return analytics.api_distribution(given.tickets())


@query
def overview(given: Given) -> DataFrame:
    return overview_flat(given.tickets(), memo.with_hits(given.requests()), given.vectors())


@query
def overview_kept(given: Given) -> DataFrame:
    """The overview from what batches have added to it, without their tables."""
    store = Store(given.spark, work_dir(given.spark, "figures"))
    day = F.dayofyear("ts")
    last = given.requests().agg(F.max(day).alias("d")).first()["d"]
    written = None
    for batch, (low, high) in enumerate([(0, last // 3), (last // 3, last // 2), (last // 2, 400)]):
        within = lambda c: (F.dayofyear(c) > low) & (F.dayofyear(c) <= high)  # noqa: B023, E731
        flagged = cut(memo.with_hits(given.requests().where(within("ts")), prior=written), "flagged")
        missed = flagged.where("not hit").select("key", F.col("ts").alias("written_at"))
        written = missed if written is None else written.unionByName(missed)
        tickets, new = (df.where(within("created_at")) for df in (given.tickets(), given.vectors()))
        store.commit(batch, {"figures": day_figures(tickets, flagged, new)})
    store.compact()
    return flat(overview_of(folded(store.read("figures"))))


@query
def accuracy_by_week(given: Given) -> DataFrame:
    return analytics.accuracy_by_period(given.tickets(), "week")


@query
def accuracy_by_day(given: Given) -> DataFrame:
    return analytics.accuracy_by_period(given.tickets(), "day")


@query
def accuracy_trend(given: Given) -> DataFrame:
    return analytics.accuracy_trend(given.tickets(), "week")


@query
def feedback_confusion(given: Given) -> DataFrame:
    return analytics.feedback_confusion(given.feedback())


@query
def feedback_matrix(given: Given) -> DataFrame:
    matrix = analytics.feedback_matrix(given.feedback())
    return matrix.select("old_label", *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in CATEGORIES])


@query
def vector_stats(given: Given) -> DataFrame:
    return analytics.vector_stats(given.vectors())


# ---- listing -------------------------------------------------------------------


@query
def list_page(given: Given) -> DataFrame:
    return listing.page(given.tickets(), PAGE, LIMIT, STATUS, CATEGORY)


@query
def list_page_deep(given: Given) -> DataFrame:
    """A page in the middle of all tickets, found by the counts per day."""
    path = work_dir(given.spark, "listed")
    append(given.tickets(), path)
    stored = given.spark.read.parquet(path)
    counts = cut(listing.day_counts(stored), "counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    return listing.page_by_counts(stored, counts, total // 2 // DEEP_LIMIT + 1, DEEP_LIMIT)


@query
def list_page_after(given: Given) -> DataFrame:
    return listing.page_after(given.tickets(), ALIVE_AT, "0", LIMIT, STATUS)


@query
def page_totals(given: Given) -> DataFrame:
    return listing.page_totals(given.tickets(), PAGE, LIMIT, STATUS, CATEGORY)


@query
def recent_feed(given: Given) -> DataFrame:
    return listing.recent(given.tickets())


@query
def ticket_by_id(given: Given) -> DataFrame:
    return listing.ticket_by_id(given.tickets(), LOOKUP_ID)


# ---- intake and keywords ---------------------------------------------------------


@query
def intake_valid(given: Given) -> DataFrame:
    return intake.accepted(given.intake())


@query
def intake_rejects(given: Given) -> DataFrame:
    return intake.rejected(given.intake()).select("id", "problem")


@query
def intake_texts(given: Given) -> DataFrame:
    texts = intake.with_texts(given.intake())
    return texts.select("id", "stored_title", "full_text", "vector_text")


@query
def memo_keys(given: Given) -> DataFrame:
    return intake.with_texts(given.intake()).select("id", "memo_key")


def _keyword_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.col("kw_category").alias("category"),
        F.col("kw_confidence").alias("confidence"),
        F.array_join("kw_indicators", ",").alias("key_indicators"),
        status_of(F.col("kw_category")).alias("status"),
    )


@query
def support_keywords(given: Given) -> DataFrame:
    return _keyword_columns(keywords.classify_by_keywords(intake.with_texts(given.intake()), "full_text"))


@query
def keyword_classify(given: Given) -> DataFrame:
    texts = intake.with_texts(given.intake())
    return _keyword_columns(keywords.classify_by_keywords(texts, "full_text", LANGUAGE_RULES))


# ---- similar tickets ---------------------------------------------------------------


def _neighbours(given: Given, **how) -> DataFrame:
    stored = given.vectors().withColumn("at", F.col("id"))
    asked = stored.select(F.col("id").alias("query_id"), "embedding", "at")
    return similar.nearest(asked, stored, **how)


@query
def similar_topk(given: Given) -> DataFrame:
    return _neighbours(given, exclude_self=True)


@query
def similar_topk_filtered(given: Given) -> DataFrame:
    return _neighbours(given, exclude_self=True, category="label_3")


@query
def similar_asof(given: Given) -> DataFrame:
    return _neighbours(given, k=CONTEXT_NEIGHBOURS, as_of=True)


@query
def neighbour_vote(given: Given) -> DataFrame:
    return similar.vote(_neighbours(given, k=CONTEXT_NEIGHBOURS, as_of=True))


@query
def similar_stored(given: Given) -> DataFrame:
    """Neighbours by the index beside a store, which followed it over four batches: two with vectors, replacements, deletions."""
    store = Store(given.spark, work_dir(given.spark, "indexed"))
    index = VectorIndex(store)
    stored = _stored_vectors(given)
    part = F.pmod(F.col("id"), F.lit(5))
    mistaken = stored.where(part == 0).withColumn("embedding", F.transform("embedding", lambda x: -x))
    withdrawn = stored.where(part == 1).withColumn("id", -F.col("id") - 1)
    store_plan.store_vectors(store, 0, stored.where(part.isin(1, 2)).unionByName(mistaken).unionByName(withdrawn))
    index.follow()
    store_plan.store_vectors(store, 1, stored.where(part > 2))
    index.follow()
    store_plan.store_vectors(store, 2, stored.where(part == 0))
    store_plan.delete_vectors(store, 3, withdrawn)
    index.follow()
    asked = stored.select(F.col("id").cast("string").alias("query_id"), "embedding")
    return index.nearest(asked, exclude_self=True)


@query
def prompt_context(given: Given) -> DataFrame:
    stored = given.vectors()
    asked = given.intake().join(stored.select("id", "embedding"), "id", "left")
    return classify_plan.prompts(asked, stored)


# ---- vector table ------------------------------------------------------------------


def _vector_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "document",
        "category",
        F.coalesce(F.col("metadata")["origin"], F.lit("none")).alias("origin"),
        F.col("embedding")[0].cast("double").alias("first_value"),
    )


def _stored_vectors(given: Given) -> DataFrame:
    return vectors.vector_rows(given.vectors())


def _vector_store(given: Given) -> Store:
    store = Store(given.spark, work_dir(given.spark, "vectors"))
    store_plan.store_vectors(store, 0, _stored_vectors(given))
    return store


@query
def vector_upsert(given: Given) -> DataFrame:
    """Updates of half of the ids, each id several times, folded over the stored rows."""
    updates = given.table("embeddings").select(
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("turn"),
        F.col("label"),
        (F.col("vec_id") + 250).alias("id"),
        F.concat(F.lit("revised "), F.col("vec_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("document"),
        F.when(F.col("label") > 4, F.lit("revised")).alias("category"),
        F.create_map(F.lit("origin"), F.lit("import")).alias("own"),
        "embedding",
    )
    store = _vector_store(given)
    # Odd labels have a third update in the first batch; the second batch has one more for low ones.
    for batch, part in ((1, "turn = 0 or (turn = 2 and label % 2 = 1)"), (2, "turn = 1 and label < 3")):
        chosen = updates.where(part)
        rows = vectors.vector_rows(chosen, "own").join(chosen.select("id", "document", "turn"), ["id", "document"])
        store_plan.store_vectors(store, batch, rows, "turn")
    return _vector_columns(store.vectors())


@query
def vector_delete(given: Given) -> DataFrame:
    """Deletions beside the rows, some ids stored again later, then all written as one batch."""
    store = _vector_store(given)
    gone = given.table("labels")
    store_plan.delete_vectors(store, 1, gone.select(F.col("doc_id").alias("id")))
    again = _stored_vectors(given).join(gone.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id")), "id", "left_semi")
    store_plan.store_vectors(store, 2, again.withColumn("document", F.lit("again")))
    store.compact()
    return _vector_columns(store.vectors())


@query
def category_examples(given: Given) -> DataFrame:
    return vectors.category_examples(_stored_vectors(given))


@query
def category_examples_one(given: Given) -> DataFrame:
    return vectors.category_examples(_stored_vectors(given), "label_3")


# ---- corrections -------------------------------------------------------------------


@query
def corrections_applied(given: Given) -> DataFrame:
    return corrections.corrected_tickets(given.tickets(), given.corrections())


@query
def feedback_log(given: Given) -> DataFrame:
    return corrections.feedback_rows(given.tickets(), given.corrections())


@query
def corrections_refused(given: Given) -> DataFrame:
    refused = corrections.refused_corrections(given.tickets(), given.corrections())
    return refused.select("correction_id", "ticket_id", "corrected_category", "problem")


@query
def cascade_delete(given: Given) -> DataFrame:
    return corrections.feedback_of_known(given.feedback(), given.tickets())


@query
def feedback_orphans(given: Given) -> DataFrame:
    return corrections.feedback_orphans(given.feedback(), given.tickets())


# ---- memo --------------------------------------------------------------------------


@query
def memo_hits(given: Given) -> DataFrame:
    return memo.with_hits(given.requests())


@query
def memo_lookup(given: Given) -> DataFrame:
    found = memo.looked_up(given.user_requests(), given.memo())
    return found.select("request_id", "key", "ts", "hit", "written_at", F.col("result.label").alias("label"))


@query
def memo_invalidate(given: Given) -> DataFrame:
    keys = given.table("events").where((F.col("event_type") == "error") & (F.col("value") > 150))
    left = memo.invalidated(given.memo(), keys.select(F.col("user_id").cast("string").alias("key")))
    return left.select("key", "written_at", F.col("result.label").alias("label"))


@query
def memo_text(given: Given) -> DataFrame:
    return memo.as_text(given.memo())


@query
def memo_live(given: Given) -> DataFrame:
    alive = memo.live_entries(given.memo(), F.lit(ALIVE_AT).cast("timestamp_ntz"))
    return alive.select("key", "written_at", F.col("result.label").alias("label"))


@query
def memo_hit_rate(given: Given) -> DataFrame:
    flagged = memo.with_hits(given.requests())
    entries = flagged.where(~F.col("hit")).select("key", F.col("ts").alias("written_at"))
    return memo.cache_stats(flagged, entries, F.lit(ALIVE_AT).cast("timestamp_ntz"))


# ---- answers and classification ----------------------------------------------------------


@query
def answers_repaired(given: Given) -> DataFrame:
    read = given.answers().withColumn("fields", fields_of(parsed(F.col("raw"))))
    answer = {n: c.alias(n) for n, c in answer_fields(F.col("fields")).items()}
    checked = read.select("ticket_id", *answer.values())
    return checked.select(
        "ticket_id",
        "usable",
        *[F.when(F.col("usable"), F.col(n)).alias(n) for n in ("category", "confidence", "reasoning")],
        F.when(F.col("usable"), F.array_join("key_indicators", ",")).alias("key_indicators"),
    )


def _asked(given: Given) -> DataFrame:
    accepted = intake.accepted(given.intake())
    embeddings = given.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return accepted.join(embeddings, "id", "left")


def _classified_columns(df: DataFrame) -> DataFrame:
    ref = F.transform(
        "similar_tickets",
        lambda r: F.concat_ws(":", r["id"], F.coalesce(r["category"], F.lit("None")), r["similarity"].cast("string")),
    )
    return df.select(
        "id",
        "memo_key",
        "category",
        "confidence",
        "reasoning",
        F.array_join("key_indicators", ",").alias("key_indicators"),
        F.array_join(ref, ";").alias("similar_tickets"),
        "cached",
        "rag_used",
        "fallback",
    )


@query
def classify_end_to_end(given: Given) -> DataFrame:
    return _classified_columns(classify_plan.classify(_asked(given), given.vectors(), given.answers()))


@query
def classify_preview(given: Given) -> DataFrame:
    return _classified_columns(
        classify_plan.classify(_asked(given), given.vectors(), given.answers(), use_memo=False)
    )


def _seeds(given: Given) -> DataFrame:
    """The given vectors under ids of their own."""
    return vectors.vector_rows(given.vectors().withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string"))))


def _stored(given: Given) -> Store:
    """A store with the given vectors, then the intake in two halves, the second reading what the first has left."""
    store = Store(given.spark, work_dir(given.spark, "store"))
    store_plan.store_vectors(store, 0, _seeds(given))
    asked = given.intake().join(given.table("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    at = memo.micros(F.col("created_at"))
    middle = asked.agg(((F.min(at) + F.max(at)) / 2).alias("at")).first()["at"]
    for batch, part in enumerate((at < F.lit(middle), at >= F.lit(middle)), start=1):
        store_plan.store_tickets(store, batch, asked.where(part), given.answers())
    return store


@query
def stored_tickets(given: Given) -> DataFrame:
    return _stored(given).tickets()


@query
def stored_vectors(given: Given) -> DataFrame:
    return _stored(given).vectors().select("id", "document", "category")


@query
def stored_memo(given: Given) -> DataFrame:
    flat = _stored(given).read("memo").select("key", "written_at", "result.*")
    ref = F.transform(
        "similar_tickets",
        lambda r: F.concat_ws(":", r["id"], F.coalesce(r["category"], F.lit("None")), r["similarity"].cast("string")),
    )
    return flat.select(
        "key", "written_at", "category", "confidence", F.array_join(ref, ";").alias("similar_tickets")
    )


@query
def stored_refused(given: Given) -> DataFrame:
    refused = _stored(given).read("refused")
    return refused.select("kind", "id", "problem", F.get_json_object("content", "$.title").alias("title"))


@query
def ticket_records(given: Given) -> DataFrame:
    """The nested records, read field by field."""
    return classify_plan.create_and_classify(_asked(given), _seeds(given), given.answers()).records.select(
        F.col("ticket.id").alias("id"),
        F.col("ticket.title").alias("title"),
        F.col("ticket.status").alias("status"),
        F.col("classification.category").alias("category"),
        F.col("classification.cached").alias("cached"),
        F.size("classification.similar_tickets").cast("bigint").alias("n_similar"),
    )


# ---- streams ---------------------------------------------------------------------------


def _stream(given: Given, table: str) -> DataFrame:
    schema = given.table(table).schema
    # A pattern, as a table is one file or a folder of files; without one a stream takes folders only.
    return jobs.file_stream(given.spark, f"{given.folder}/{table}.parque[t]", schema)


def _folders(given: Given, name: str) -> tuple[str, str]:
    base = work_dir(given.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def _sql_over(given: Given, sql: str, **streams: DataFrame) -> DataFrame:
    return given.spark.sql(sql, **streams)


@query
def stream_intake(given: Given) -> DataFrame:
    out, checkpoint = _folders(given, "intake")
    jobs.intake(_sql_over(given, INTAKE, documents=_stream(given, "documents")), out, checkpoint, LANGUAGE_RULES).awaitTermination()
    rows = given.spark.read.parquet(out)
    return rows.select("id", "memo_key", F.col("kw_category").alias("category"), F.col("kw_confidence").alias("confidence"), "status")


PARTS = 4


def _arriving(given: Given, rows: DataFrame, by: str, name: str) -> Iterator[DataFrame]:
    """rows come into a folder in PARTS parts in the order of `by`; after each part, the stream of the folder.

    A job that is run on each of these streams with one checkpoint has the files of a part, as
    many as its tasks wrote, in one batch.
    """
    folder = work_dir(given.spark, name)
    parts = rows.withColumn("_at", memo.micros(F.col(by)))
    low, high = parts.agg(F.min("_at"), F.max("_at")).first()
    step = (high - low) / PARTS
    for k in range(PARTS):
        chosen = (F.col("_at") >= low + k * step) if k else F.lit(True)
        if k < PARTS - 1:
            chosen &= F.col("_at") < low + (k + 1) * step
        parts.where(chosen).drop("_at").write.mode("append").parquet(folder)
        yield jobs.file_stream(given.spark, folder, rows.schema)


@query
def stream_corrections(given: Given) -> DataFrame:
    """Tickets and corrections come in side by side, many corrections before their tickets."""
    return _corrected_store(given).tickets()


@query
def stream_refused(given: Given) -> DataFrame:
    store = _corrected_store(given)
    refused = store.read("refused").unionByName(store_plan.still_pending(store))
    return refused.select("kind", F.col("id").alias("correction_id"), F.get_json_object("content", "$.ticket_id").alias("ticket_id"), "problem")


def _corrected_store(given: Given) -> Store:
    store = Store(given.spark, work_dir(given.spark, "corrected"))
    tickets = _arriving(given, given.tickets(), "created_at", "tickets")
    feed = _arriving(given, given.corrections(), "corrected_at", "corrections")
    for came, corrected in zip(tickets, feed, strict=True):
        jobs.store_corrections(came, corrected, store, f"{store.root}/checkpoint").awaitTermination()
    return store


@query
def stream_memo(given: Given) -> DataFrame:
    out, checkpoint = _folders(given, "memo")
    for requests in _arriving(given, given.requests(), "ts", "requests"):
        jobs.memo(requests, out, checkpoint).awaitTermination()
    return given.spark.read.parquet(f"{out}/hits").select("request_id", "key", "ts", "hit")


@query
def stream_dedup(given: Given) -> DataFrame:
    out, checkpoint = _folders(given, "dedup")
    requests = given.requests().withColumn("ts", F.col("ts").cast("timestamp"))
    for came in _arriving(given, requests, "ts", "requests"):
        jobs.first_seen(came, out, checkpoint).awaitTermination()
    seen = jobs.first_seen_now(given.spark, out)
    return seen.select("key", F.col("period_start").cast("timestamp_ntz").alias("period_start"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def _ticket_stream(given: Given) -> DataFrame:
    tickets = _sql_over(given, TICKETS, events=_stream(given, "events"))
    return tickets.withColumn("created_at", F.col("created_at").cast("timestamp"))


@query
def stream_window(given: Given) -> DataFrame:
    out, checkpoint = _folders(given, "window")
    jobs.accuracy_windows(_ticket_stream(given), out, checkpoint).awaitTermination()
    return jobs.latest_version(given.spark, out)


@query
def stream_totals(given: Given) -> DataFrame:
    out, checkpoint = _folders(given, "totals")
    jobs.running_totals(_ticket_stream(given), out, checkpoint).awaitTermination()
    totals = jobs.latest_version(given.spark, out)
    return totals.withColumn("mean_confidence", F.round("mean_confidence", 9))
