"""Classify a batch of tickets: memo, neighbours, model answers, keywords.

The model step itself stays outside: `prompts` gives the texts to ask, a table
of raw answers comes back, `classify` does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import CONTEXT_NEIGHBOURS, MEMO_TTL_SECONDS
from deskline.functions.answers import answer_fields, fields_of, parsed
from deskline.functions.prompts import context_line, context_text, prompt_text
from deskline.functions.text import memo_key, ticket_text, vector_text
from deskline.operators import memo as memo_ops
from deskline.operators.keywords import classify_by_keywords
from deskline.operators.similar import nearest, neighbour_refs, with_documents
from deskline.operators.skew import frequent_keys, join_on_key
from deskline.operators.vectors import vector_rows
from deskline.session import cut
from deskline.sources.schemas import NEIGHBOUR_REF, RESULT
from deskline.sources.tables import new_ticket_rows

RESULT_FIELDS = ["category", "confidence", "reasoning", "key_indicators"]


def _no_refs_type() -> str:
    return f"array<{NEIGHBOUR_REF.simpleString()}>"


def _no_refs() -> Column:
    return F.array().cast(_no_refs_type())


def judged(tickets: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Per ticket: the checked model answer where usable, else the keyword result.

    Of several answers to a ticket the one with the latest `answered_at` counts, where
    there is such a column; else, and of equal times, the greatest text.
    Output: id, memo_key, created_at, usable and the result fields.
    """
    text = ticket_text(F.col("title"), F.col("description"))
    base = tickets.select("id", "created_at", text.alias("_text"), memo_key(text).alias("memo_key"))
    if answers is None:
        base = base.withColumn("raw", F.lit(None).cast("string"))
    else:
        order = [c for c in ("answered_at", "raw") if c in answers.columns]
        latest = answers.groupBy(F.col("ticket_id").alias("id")).agg(F.max(F.struct(*order))["raw"].alias("raw"))
        base = base.join(latest, "id", "left")
    answer = answer_fields(F.col("_fields"))
    read = base.withColumn("_fields", fields_of(parsed(F.col("raw")))).select(
        "id", "created_at", "memo_key", "_text", *[c.alias(n) for n, c in answer.items()]
    )
    # Only texts without a usable answer are searched for keywords.
    read = read.withColumn("_text", F.when(~F.col("usable"), F.col("_text")))
    scored = classify_by_keywords(read, "_text")
    fallback = {
        "category": "kw_category",
        "confidence": "kw_confidence",
        "reasoning": "kw_reasoning",
        "key_indicators": "kw_indicators",
    }
    return scored.select(
        "id",
        "memo_key",
        "created_at",
        "usable",
        *[F.when(F.col("usable"), F.col(n)).otherwise(F.col(kw)).alias(n) for n, kw in fallback.items()],
    )


def _with_memo(results: DataFrame, memo: DataFrame | None, ttl: int) -> DataFrame:
    """Adds `cached`, `writes`, `writer_id` and `kept`, the prior result of a hit.

    Only usable answers are remembered; keyword results never are.
    """
    asked = results.select(
        F.col("id").alias("request_id"), F.col("memo_key").alias("key"), F.col("created_at").alias("ts"), "usable"
    )
    requests = asked.drop("usable")
    written = memo_ops.misses(asked.where("usable").drop("usable"), ttl, memo)
    written = cut(written.select("key", F.col("ts").alias("written_at"), F.col("request_id").alias("entry_id")))
    id_type = results.schema["id"].dataType
    result = f"struct<writer_id:{id_type.simpleString()},kept:{RESULT.simpleString()}>"

    def entry(writer, kept):
        return F.struct(writer.cast(id_type).alias("writer_id"), kept.cast(RESULT).alias("kept")).cast(result).alias("result")

    entries = written.select("key", "written_at", "entry_id", entry(F.col("entry_id"), F.lit(None)))
    if memo is not None:
        entries = entries.unionByName(
            memo.select("key", "written_at", F.lit(None).cast(id_type).alias("entry_id"), entry(F.lit(None), F.col("result")))
        )
    seen = memo_ops.looked_up(requests, entries, ttl).select(
        F.col("request_id").alias("id"), F.col("hit").alias("cached"), "result.writer_id", "result.kept"
    )
    writes = written.select(F.col("entry_id").alias("id"), F.lit(True).alias("writes"))
    return (
        results.join(seen, "id", "left")
        .join(writes, "id", "left")
        .withColumns({"writes": F.coalesce("writes", F.lit(False)), "cached": F.coalesce("cached", F.lit(False))})
    )


def _decided(results: DataFrame, frequent: list) -> DataFrame:
    """Puts the remembered result in the place of a hit's own one."""
    source = results.where("writes").select(
        F.col("id").alias("writer_id"), F.struct(*RESULT_FIELDS).alias("_source")
    )
    joined = join_on_key(results, source, "writer_id", "left", frequent)
    chosen = [
        F.when(~F.col("cached"), F.col(n))
        .when(F.col("writer_id").isNotNull(), F.col(f"_source.{n}"))
        .otherwise(F.col(f"kept.{n}"))
        .alias(n)
        for n in RESULT_FIELDS
    ]
    return joined.select(
        "id", "memo_key", "created_at", "usable", "cached", "writes", "writer_id",
        F.col("kept.similar_tickets").alias("kept_refs"), *chosen,
    )


def search_inputs(tickets: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus of the as-of search: only earlier stored vectors count."""
    at = memo_ops.micros(F.col("created_at")).alias("at")
    queries = tickets.select(F.col("id").alias("query_id"), "embedding", at)
    return queries, corpus.select("id", "embedding", "category", at)


def prompts(tickets: DataFrame, corpus: DataFrame, k: int = CONTEXT_NEIGHBOURS) -> DataFrame:
    """The prompt of every ticket: `id, context, prompt`.

    tickets: id, title, description, created_at, embedding.
    corpus:  id, document, category, embedding, created_at.
    """
    found = with_documents(nearest(*search_inputs(tickets, corpus), k=k, as_of=True), corpus)
    line = context_line(F.col("category"), F.col("document"), F.col("similarity"))
    lines = neighbour_refs(found, {"lines": line}).select(F.col("query_id").alias("id"), "lines")
    joined = tickets.select("id", "title", "description").join(lines, "id", "left")
    context = context_text(F.col("lines"))
    return joined.select(
        "id", context.alias("context"), prompt_text(F.col("title"), F.col("description"), context).alias("prompt")
    )


def classify(
    tickets: DataFrame,
    corpus: DataFrame | None = None,
    answers: DataFrame | None = None,
    memo: DataFrame | None = None,
    use_memo: bool = True,
    add_batch: bool = False,
    k: int = CONTEXT_NEIGHBOURS,
    ttl: int = MEMO_TTL_SECONDS,
) -> DataFrame:
    """One classification per ticket.

    tickets: id (unique), title, description, created_at, embedding when there
             is a corpus.
    corpus:  id, category, embedding, created_at; None for no neighbours.
    answers: ticket_id (unique), raw; tickets without a usable one take keywords.
    memo:    key, written_at, result from before this batch.
    add_batch: the batch's own earlier tickets are candidates as well, as if the
             tickets had come in one after the other.

    Output: id, memo_key, created_at, category, confidence, reasoning,
    key_indicators, similar_tickets, cached, rag_used, fallback, writes.
    `use_memo=False` without a sink is the preview of a classification.
    """
    results = judged(tickets, answers)
    frequent: list = []
    if use_memo:
        results = cut(_with_memo(cut(results, "judged"), memo, ttl), "remembered")
        # One result may be the source of very many hits.
        frequent = frequent_keys(results, "writer_id")
        results = _decided(results, frequent)
    else:
        results = results.withColumns(
            {
                "cached": F.lit(False),
                "writes": F.lit(False),
                "writer_id": F.lit(None).cast(results.schema["id"].dataType),
                "kept_refs": _no_refs(),
            }
        )
    results = cut(results, "decided")
    if corpus is None:
        refs = None
    else:
        refs = _references(tickets, results, corpus, add_batch, k)
    return _assembled(results, refs, frequent)


def _references(
    tickets: DataFrame, results: DataFrame, corpus: DataFrame, add_batch: bool, k: int
) -> DataFrame:
    """similar_tickets of the tickets that reached the model and got an answer."""
    asked = tickets.join(results.where(~F.col("cached") & F.col("usable")).select("id"), "id", "left_semi")
    stored = corpus.select(F.col("id").cast("string").alias("id"), "category", "embedding", "created_at")
    if add_batch:
        own = tickets.select("id", "embedding", "created_at").join(results.select("id", "category"), "id")
        stored = stored.unionByName(own.select(F.col("id").cast("string").alias("id"), "category", "embedding", "created_at"))
    found = nearest(*search_inputs(asked, stored), k=k, as_of=True)
    return cut(neighbour_refs(found).withColumnRenamed("query_id", "id"), "references")


def _assembled(results: DataFrame, refs: DataFrame | None, frequent: list) -> DataFrame:
    if refs is None:
        none = F.lit(None).cast(_no_refs_type())
        joined = results.withColumns({"similar_tickets": none, "_written_refs": none})
    else:
        joined = results.join(refs, "id", "left")
        # A hit carries the neighbours stored with the entry it found.
        written = refs.select(F.col("id").alias("writer_id"), F.col("similar_tickets").alias("_written_refs"))
        joined = join_on_key(joined, written, "writer_id", "left", frequent)
    own = F.coalesce("similar_tickets", _no_refs())
    shown = (
        F.when(F.col("cached"), F.coalesce("_written_refs", "kept_refs", _no_refs()))
        .when(F.col("usable"), own)
        .otherwise(_no_refs())
    )
    return joined.select(
        "id",
        "memo_key",
        "created_at",
        *RESULT_FIELDS,
        shown.alias("similar_tickets"),
        "cached",
        (~F.col("cached") & F.col("usable") & (F.size(own) > 0)).alias("rag_used"),
        (~F.col("cached") & ~F.col("usable")).alias("fallback"),
        "writes",
    )


def memo_entries(classified: DataFrame) -> DataFrame:
    """The memo rows a classified batch adds."""
    result = F.struct(*RESULT_FIELDS, "similar_tickets").cast(RESULT)
    return classified.where("writes").select(
        F.col("memo_key").alias("key"), F.col("created_at").alias("written_at"), result.alias("result")
    )


@dataclass
class Stored:
    """What one intake batch adds to the stores, and its nested records."""

    tickets: DataFrame
    vectors: DataFrame
    memo: DataFrame
    records: DataFrame


def create_and_classify(
    tickets: DataFrame,
    corpus: DataFrame | None = None,
    answers: DataFrame | None = None,
    memo: DataFrame | None = None,
    **options,
) -> Stored:
    """Classify a batch and derive the rows to append to each store.

    Ids and times come with the tickets, so a repeated batch gives the same rows.
    """
    classified = cut(
        classify(tickets, corpus, answers, memo, add_batch=corpus is not None, **options), "classified"
    )
    texts = tickets.select("id", "title", "description", *(["embedding"] if "embedding" in tickets.columns else []))
    joined = texts.join(classified, "id")
    rows = new_ticket_rows(joined, F.col("id").cast("string"), F.col("created_at"))
    if "embedding" in texts.columns:
        document = vector_text(F.col("title"), F.col("description"))
        vectors = vector_rows(joined.select(F.col("id").cast("string").alias("id"), document.alias("document"), "category", "embedding", "created_at"))
    else:
        vectors = None
    return Stored(rows, vectors, memo_entries(classified), nested_records(rows, classified))


def nested_records(tickets: DataFrame, classified: DataFrame) -> DataFrame:
    """Ticket and classification as two nested records per row."""
    answer = classified.select(
        F.col("id").cast("string").alias("id"),
        F.struct(*RESULT_FIELDS, "similar_tickets", "cached", "rag_used").alias("classification"),
    )
    return tickets.select("id", F.struct(*[F.col(c) for c in tickets.columns]).alias("ticket")).join(answer, "id").select(
        "ticket", "classification"
    )
