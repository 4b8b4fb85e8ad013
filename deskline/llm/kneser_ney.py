"""Quality by perplexity under interpolated modified Kneser-Ney models.

Words are predicted by the n-grams of `word_ngrams`, which grow with the trusted
text; this module spells the words that those do not know, and judges.  The units
of spelling are symbols: the bytes of a text folded into 64 classes (letters, one
class for all capitals, digits, punctuation by itself or in small classes, the
bytes of other characters in 16 classes), so the model of order 4 never has more
than 64**4 entries whatever the corpus, while its counts grow with all trusted
text.  Tasks count their own text and emit each n-gram once; counts, contexts
and continuation counts are aggregates and joins in Spark, sharded by n-gram or
context.  The resulting table (2 bytes an entry, 32 MB at most) is what every
task looks its documents' n-grams up in.

A document is judged twice, by its words and by its spelling: it has to stay
below the language's quantile of trusted documents in both.  Words tell real words in
senseless order, spelling tells strange strings, which to the words are only unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm import word_ngrams
from deskline.llm import words as W
from deskline.llm.frames import arrow_schema, mapped, matched
from deskline.session import cut, freed

ORDER = 4
BITS = 6  # of a symbol
SYMBOLS = 1 << BITS
QUANTILE = 0.999  # of trusted documents of a language, for words and for spelling
TAIL = 0.1  # the share of them whose excess tells where that quantile lies
PRIOR = 400  # symbols at the language's median that every document is given
STEPS = 2000  # per bit; 16 bits hold 32 bits of surprise


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)  # 0: control characters
    out[[0x09, 0x20]] = 1
    out[[0x0A, 0x0D]] = 2
    out[0x30:0x3A] = 3
    out[0x41:0x5B] = 4
    out[0x61:0x7B] = np.arange(5, 31)
    for i, group in enumerate([".", ",", ";:", "!", "?", "'`", '"', "-", "()[]{}", "/\\", "|", "#", "*", "$", "%", "&", "=+~^<>@_"]):
        for c in group:
            out[ord(c)] = 31 + i
    out[0x80:] = 48 + (np.arange(0x80, 0x100) & 15)
    return out


_CLASS = _classes()


def _grams(column: pa.Array, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(edges, n-grams): one n-gram per byte of each text, or per byte of `at`; before a text's start line ends are assumed."""
    data, offsets = W.bytes_of(column)
    if at is not None:
        symbols = _CLASS[data]
        grams = symbols[at].astype(np.int32)
        far = np.full(len(data), ORDER, np.uint8)  # from the text's start, ORDER at most
        for k in range(ORDER - 1, -1, -1):
            far[offsets[:-1][np.diff(offsets) > k] + k] = k
        far = far[at]
        for k in range(1, ORDER):
            grams |= np.where(far < k, 2, symbols[np.maximum(at - k, 0)]).astype(np.int32) << (BITS * k)
        return offsets, grams
    symbols = _CLASS[data].astype(np.int32)
    grams = symbols.copy()
    for k in range(1, ORDER):
        before = np.full(len(data), 2, np.int32)
        before[k:] = symbols[:-k]
        for j in range(k):
            before[offsets[:-1][np.diff(offsets) > j] + j] = 2
        grams |= before << (BITS * k)
    return offsets, grams


# ---- training -----------------------------------------------------------------


def _counted(documents: DataFrame) -> DataFrame:
    """`gram, n` over all texts; a task emits each of its n-grams once."""
    schema = arrow_schema("gram int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for part in W.slices(batch, "text", word_ngrams.SLICE_BYTES):
                _, grams = _grams(part.column("text"))
                found, n = np.unique(grams, return_counts=True)
                if total is None:
                    total = np.zeros(SYMBOLS**ORDER, np.uint32)
                total[found] += n.astype(np.uint32)
        if total is not None:
            seen = np.flatnonzero(total)
            for i in range(0, len(seen), 100_000):
                some = seen[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], schema=schema)

    return documents.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _order(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`gram, own`: the discounted share of a seen n-gram; `context, weight`: what a context leaves to shorter ones)."""
    n = {k: v or 0 for k, v in counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first().asDict().items()}
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] and n["n2"] else 0.5
    d = [0.0] + [min(max(i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"], 0.1), i - 0.1) if n[f"n{i}"] and n[f"n{i + 1}"] else 0.5 * i for i in (1, 2, 3)]
    discount = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
    with_context = counts.withColumn("context", F.shiftright("gram", BITS))
    context = with_context.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("left"))
    own = with_context.join(context, "context").select("gram", ((F.col("n") - discount) / F.col("total")).alias("own"))
    return own, context.select("context", (F.col("left") / F.col("total")).alias("weight"))


def train(documents: DataFrame) -> np.ndarray:
    """Surprise of every n-gram in 1 / STEPS bits, as 16-bit numbers; without any text all symbols are equal."""
    counts = cut(_counted(documents), "grams")
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # how many different symbols come before a shorter n-gram
        shorter = orders[-1].groupBy(F.col("gram").bitwiseAND(F.lit(SYMBOLS**k - 1)).alias("gram")).agg(F.count("*").alias("n"))
        orders.append(shorter)
    p = np.full(1, 1 / SYMBOLS, np.float32)
    for k, table in enumerate(reversed(orders), start=1):
        own, context = (x.toArrow() for x in _order(table))
        weight = np.ones(SYMBOLS ** (k - 1), np.float32)
        weight[context["context"].to_numpy()] = context["weight"].to_numpy()
        # p(w | abc) = own + weight(abc) p(w | bc); p(. | bc) is repeated for every a.
        lower = p.reshape(-1, SYMBOLS) if k > 1 else np.full((1, SYMBOLS), p[0], np.float32)
        full = weight.reshape(-1, lower.shape[0])[:, :, None] * lower[None, :, :]
        p = full.reshape(-1)
        p[own["gram"].to_numpy()] += own["own"].to_numpy().astype(np.float32)
    return np.minimum(-np.log2(np.maximum(p, 1e-9)) * STEPS, 65535).astype(np.uint16)


# ---- scoring --------------------------------------------------------------------


def surprise(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """All columns and `_bits` (spelling of what precedes the first word), `_spelled` (of the whole text), `_symbols`.

    The text is the column `text`, or if there is none, that of the struct `row`.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.tobytes())
    inside = None if "text" in documents.columns else documents.schema["row"].dataType.fieldNames().index("text")
    schema = documents.limit(0).withColumns({"_bits": F.lit(0.0), "_spelled": F.lit(0.0), "_symbols": F.lit(0).cast("long")}).schema

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint16)
        texts = batch.column("text") if inside is None else pc.struct_field(batch.column("row"), [inside])
        beside = batch if inside is None else batch.append_column("text", texts)
        for part in W.slices(beside, "text", word_ngrams.SLICE_BYTES):
            text = part.column("text")
            part = part.select(batch.schema.names)
            offsets, grams = _grams(text)
            total = np.concatenate([[0], np.cumsum(table[grams], dtype=np.int64)])
            words = W.words_of(text)
            some = np.diff(words.first) > 0
            stop = offsets[1:].copy()
            stop[some] = words.start[words.first[:-1][some]]
            bits = (total[stop] - total[offsets[:-1]]) / STEPS
            spelled = (total[offsets[1:]] - total[offsets[:-1]]) / STEPS
            columns = [*part.columns, pa.array(bits), pa.array(spelled), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "_bits", "_spelled", "_symbols"])

    return mapped(documents, score, schema)


def _with_words(spelled: DataFrame, words: DataFrame) -> DataFrame:
    """`_bits` of the words added, by `_key`."""
    joined = matched(spelled, words, "_key", "left")
    return joined.withColumn("_bits", F.col("_bits") + F.coalesce("_words", F.lit(0.0))).drop("_key", "_words")


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


MODELS = ("bits", "spelled")


def _thresholds(scores: DataFrame, quantile: float) -> tuple[DataFrame, dict]:
    """(`_lang` and per model `median, threshold`; the same over all languages) from trusted documents' scores.

    A threshold is the quantile as the tail tells it: scores beyond the upper tenth are
    taken to fall off exponentially, so few trusted documents give one too.
    """
    with_text = cut(scores.where(F.col("_symbols") > 0), "trusted-scores")
    mean = {m: F.percentile_approx(F.col(f"_{m}") / F.col("_symbols"), 0.5, 10_000).alias(f"median_{m}") for m in MODELS}
    def limits(rows: DataFrame, *by: str) -> DataFrame:
        scored = rows.withColumns({f"score_{m}": _score(m) for m in MODELS})
        tail = scored.groupBy(*by).agg(*[F.percentile_approx(f"score_{m}", 1 - TAIL, 10_000).alias(f"tail_{m}") for m in MODELS])
        beyond = scored.join(tail, list(by)) if by else scored.withColumns({f"tail_{m}": tail.select(f"tail_{m}").scalar() for m in MODELS})
        excess = {m: F.avg(F.when(F.col(f"score_{m}") > F.col(f"tail_{m}"), F.col(f"score_{m}") - F.col(f"tail_{m}"))) for m in MODELS}
        reach = math.log(TAIL / (1 - quantile))
        return beyond.groupBy(*by).agg(
            *[(F.max(f"tail_{m}") + F.coalesce(e, F.lit(0.0)) * reach).alias(f"threshold_{m}") for m, e in excess.items()]
        )

    median = with_text.groupBy("_lang").agg(*mean.values())
    by_lang = limits(with_text.join(median, "_lang"), "_lang", *median.columns[1:])
    over_all = {k: 0.0 if v is None else v for k, v in with_text.agg(*mean.values()).first().asDict().items()}
    top = limits(with_text.withColumns({k: F.lit(v) for k, v in over_all.items()})).first().asDict()
    return by_lang, over_all | {k: float("inf") if v is None else v for k, v in top.items()}


def _score(model: str) -> Column:
    """Mean surprise per symbol, PRIOR symbols of the language's median included."""
    return (F.col(f"_{model}") + PRIOR * F.col(f"median_{model}")) / (F.col("_symbols") + PRIOR)


def _model(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(trusted ids, table of surprises of symbols, `_key, _words` of all documents)"""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    trusted = cut(trusted.where(F.col("doc_id").isNotNull()).distinct(), "trusted")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = matched(texts, trusted, "doc_id", "left_semi")
    model = train(own)
    marked = matched(texts, trusted.withColumn("_trusted", F.lit(True)), "doc_id", "left").select("text", F.col("_trusted").isNotNull().alias("_trusted"))
    return trusted, model, word_ngrams.bits(marked, word_ngrams.train(own), model, STEPS, _grams)


def _judged(scored: DataFrame, limits: tuple[DataFrame, dict]) -> DataFrame:
    """Adds per model `score` and `threshold`, and `_kept`, to rows with `_bits, _spelled, _symbols, _lang`."""
    by_lang, over_all = limits
    joined = matched(scored, cut(by_lang, "thresholds"), "_lang", "left")
    joined = joined.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in over_all.items()})
    joined = joined.withColumns({f"score_{m}": _score(m) for m in MODELS})
    below = [F.col(f"score_{m}") <= F.col(f"threshold_{m}") for m in MODELS]
    return joined.withColumn("_kept", below[0] & below[1])


def quality(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """`doc_id, lang, n_symbols, perplexity, threshold, spelling_perplexity, spelling_threshold, kept` per document.

    Trusted documents are those with labels.quality = 1.  A score is the mean
    surprise per symbol, PRIOR symbols of the language's median included, so that
    short texts differ little from it; perplexity is 2 to its power.  A threshold is
    the quantile of the scores of the language's trusted documents, estimated from their
    upper tenth, for the words and for the spelling; a document is kept if it is above neither.  A language without trusted
    documents (null is a language) takes the thresholds over all of them; without
    any trusted document all are kept.  Null and empty texts have no symbols and
    are kept.  Repeated rows give a row each; of several labels of an id one 1 is
    enough; labels without an id count for nothing.
    """
    with freed(documents.sparkSession):
        trusted, model, words = _model(documents, labels)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", _lang().alias("_lang"), F.xxhash64("text").alias("_key"))
    with freed(documents.sparkSession):
        scores = cut(_with_words(surprise(slim, model).drop("text"), words), "scores")
    limits = _thresholds(matched(scores, trusted, "doc_id", "left_semi"), quantile)
    power = lambda c: F.pow(F.lit(2.0), c)
    return _judged(scores, limits).select(
        "doc_id",
        "lang",
        F.col("_symbols").alias("n_symbols"),
        power("score_bits").alias("perplexity"),
        power("threshold_bits").alias("threshold"),
        power("score_spelled").alias("spelling_perplexity"),
        power("threshold_spelled").alias("spelling_threshold"),
        (F.col("_kept") | (F.col("_symbols") == 0)).alias("kept"),
    )


def of_good_quality(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents, all columns, that `quality` keeps."""
    with freed(documents.sparkSession):
        trusted, model, words = _model(documents, labels)
    own = matched(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", _lang().alias("_lang"), F.xxhash64("text").alias("_key")), trusted, "doc_id", "left_semi")
    with freed(documents.sparkSession):
        limits = _thresholds(_with_words(surprise(own, model).drop("text"), words), quantile)
    # The row travels as one value, so no name in it can clash.
    rows = documents.select(F.struct(*documents.columns).alias("row"), _lang().alias("_lang"), F.xxhash64("text").alias("_key"))
    kept = _judged(_with_words(surprise(rows, model), words), limits).where(F.col("_kept") | (F.col("_symbols") == 0))
    return kept.select(*[F.col("row")[c].alias(c) for c in documents.columns])
