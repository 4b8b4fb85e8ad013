"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other labelled documents, both
with a Dirichlet prior proportional to its frequency in all of them; tokens that
are not clearly toxic cost a little.  All maximal segments of a document's scores
are found in one linear scan.  Scores of segments in clean text follow an
extreme-value law, whose two parameters turn them into evidence that is comparable
between lengths; a logistic fit on documents kept apart makes a probability of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm import words as W
from deskline.llm.frames import arrow_schema, mapped, matched
from deskline.session import cut

TRAIN_DOCUMENTS = 40_000  # labelled documents used at most: those with the lowest hash of their id
FOLDS = 5  # fold 0 is held out, fold 1 calibrates, the others give the log-odds
PRIOR = 0.1  # weight of the prior, as a share of all counts
MIN_Z = 2.5
MIN_DOCUMENTS = 3  # toxic documents with the token
MAX_TOKENS = 50_000  # tokens with a score of their own: the highest z
DRIFT = 0.05  # cost of any other token


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


# ---- training -------------------------------------------------------------------


def _counts(labelled: DataFrame) -> DataFrame:
    """`token (hash), toxic, clean`: in how many documents of each kind; from `text, toxic`."""
    schema = arrow_schema("token long, toxic long, clean long")

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batch, "text"):
            words = W.words_of(part.column("text"), W.ALNUM, W.LOWER)
            text = np.repeat(np.arange(part.num_rows), np.diff(words.first))
            order = np.lexsort((words.hash, text))
            text, token = text[order], words.hash[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[text[new]]
            found, where = np.unique(token[new], return_inverse=True)
            yes = np.bincount(where, weights=toxic, minlength=len(found)).astype(np.int64)
            no = np.bincount(where, minlength=len(found)) - yes
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(yes), pa.array(no)], schema=schema)

    counted = mapped(labelled.select("text", "toxic"), count, "token long, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _scores(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(token hashes ascending, their scores, the share of each in clean text as lambda needs it)"""
    counts = cut(_counts(labelled), "token-counts")
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = float(sums[0] or 0), float(sums[1] or 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0), 1.0
    prior = PRIOR * (toxic + clean)
    alpha = (F.col("toxic") + F.col("clean")) * PRIOR
    yes, no = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(yes / (toxic + prior - yes)) - F.log(no / (clean + prior - no))
    z = odds / F.sqrt(1 / yes + 1 / no)
    best = counts.where(F.col("toxic") >= MIN_DOCUMENTS).select("token", odds.alias("odds"), z.alias("z"), (no / (clean + prior)).alias("share"))
    rows = best.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "token").limit(MAX_TOKENS).toArrow()
    token = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    odds, share = rows["odds"].to_numpy()[order], rows["share"].to_numpy()[order]
    return token[order], odds, _lambda(odds, share)


def _lambda(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(l s)] = 1 over the tokens of clean text."""

    def excess(rate: float) -> float:
        return float((share * np.exp(rate * odds)).sum() + (1 - share.sum()) * math.exp(-rate * DRIFT) - 1)

    low, high = 1e-4, 5.0
    if excess(low) >= 0:
        return low
    while high - low > 1e-6:
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


# ---- scanning ---------------------------------------------------------------------


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), in order.

    places, scores: the tokens with positive scores; all others cost `drift`.
    Each token joins or opens a segment; a segment is merged with those before it
    as long as that makes it larger.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        before = total - drift * (place - last - 1)
        total, last = before + score, place
        first = place
        at = len(found) - 1
        while at >= 0:
            if found[at][2] >= before:
                at -= 1
            elif found[at][3] >= total:
                break
            else:
                first, before = found[at][0], found[at][2]
                del found[at:]
                at = len(found) - 1
        found.append((first, place, before, total))
    return [(a, b, after - before) for a, b, before, after in found]


def _evidence(scores: list[float], n: int, rate: float, k: float) -> float:
    """How far the best r segments' scores lie above what n tokens of clean text give, for the best r."""
    best = total = 0.0
    each = math.log(max(k * n, 1.0))
    for r, score in enumerate(sorted(scores, reverse=True), start=1):
        total += rate * score - each + math.log(r)  # r segments may come in any order: - r ln(kn) + ln r!
        best = max(best, total)
    return best


class Model:
    """Token scores, the two extreme-value parameters and the two of the logistic fit."""

    def __init__(self, token: np.ndarray, odds: np.ndarray, rate: float, k: float = 1.0, slope: float = 1.0, offset: float = 0.0):
        self.token, self.odds, self.rate, self.k, self.slope, self.offset = token, odds, rate, k, slope, offset

    def segments(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(number of tokens, segments) of each text."""
        words = W.words_of(column, W.ALNUM, W.LOWER)
        n = np.diff(words.first)
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, words.hash), len(self.token) - 1)
            hit = np.flatnonzero(self.token[at] == words.hash)
        else:
            at = hit = np.zeros(0, np.int64)
        edges = np.searchsorted(hit, words.first)
        for i in range(len(n)):
            own = hit[edges[i] : edges[i + 1]]
            places = (own - words.first[i]).tolist()
            yield int(n[i]), maximal_segments(places, self.odds[at[own]].tolist()) if places else []

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by damped Newton steps, a little pulled towards (1, 0), so one class alone is no trouble."""

    def loss(w: np.ndarray) -> float:
        line = w[0] * x + w[1]
        return float((np.logaddexp(0, line) - y * line).sum() + (w[0] - 1) ** 2 / 2 + 0.005 * w[1] ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -500, 500)))
        gradient = np.array([((p - y) * x).sum() + w[0] - 1, (p - y).sum() + 0.01 * w[1]])
        v = p * (1 - p)
        curve = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(curve, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most TRAIN_DOCUMENTS labelled documents outside fold 0."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    usable = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 0)
    usable = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS), "labelled")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    labelled = cut(matched(own, usable, "doc_id", "inner"), "labelled-texts")
    model = Model(*_scores(labelled.where(fold(F.col("doc_id")) > 1)))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in W.slices(batch, "text"):
            rows += [(t, n, [s[2] for s in found]) for t, (n, found) in zip(part.column("toxic").to_pylist(), model.segments(part.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = arrow_schema("toxic int, n long, scores array<double>")
    rows = mapped(labelled.where(fold(F.col("doc_id")) == 1).select("toxic", "text"), scan, "toxic int, n long, scores array<double>").collect()
    clean = [(r["n"], max(r["scores"], default=0.0)) for r in rows if not r["toxic"] and r["n"]]
    if clean:  # P(best segment < s) = exp(-k n exp(-rate s)): the k that explains the clean documents best
        model.k = len(clean) / sum(n * math.exp(-model.rate * s) for n, s in clean)
    x = np.array([_evidence(r["scores"], r["n"], model.rate, model.k) for r in rows])
    if len(x):
        model.slope, model.offset = _logistic(x, np.array([float(r["toxic"]) for r in rows]))
    return model


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted, evidence, passages` per document.

    passages: the maximal segments as (first word, last word, score), words being
    runs of letters, digits and all beyond ASCII, from 0.  Only the text decides a
    score.  Null and empty texts have no evidence and get the score of that.  Of
    several labels of an id a toxic one wins; null labels and labels without an
    id are ignored, and without labels of both kinds every score is the same.
    Every row gives one row; a null doc_id is in no fold (held_out is false).
    """
    model = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = "doc_id long, score double, predicted int, evidence double, passages array<struct<first:int,last:int,score:double>>"
    schema = arrow_schema(out)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in W.slices(batch, "text"):
            rows = []
            for doc, (n, found) in zip(part.column("doc_id").to_pylist(), own.segments(part.column("text"))):
                evidence = _evidence([s[2] for s in found], n, own.rate, own.k)
                p = own.probability(evidence)
                rows.append((doc, p, int(p >= 0.5), evidence, [{"first": a, "last": b, "score": s} for a, b, s in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, out)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", "evidence", "passages")
