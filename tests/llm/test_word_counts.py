"""The word model's counts, discounts and probabilities against plain ones."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.brute import WORD

from deskline.llm import kneser_ney, word_ngrams

TEXTS = ["a b a b a c", "a b c a b d a", "b a b a a", "c c c a b", "a", "d a b a b", "", None, "a b a c b d b a d c a b a"]




def shares(counts, context):
    """n-gram -> discounted share; context -> what is left, as modified Kneser-Ney has it."""
    n = Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.1) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
    total, left = Counter(), Counter()
    for gram, k in counts.items():
        total[context(gram)] += k
        left[context(gram)] += d[min(k, 3) - 1]
    own = {g: (k - d[min(k, 3) - 1]) / total[context(g)] for g, k in counts.items()}
    return own, {c: left[c] / total[c] for c in total}


@pytest.fixture(scope="module")
def found(spark):
    """Spark's bits of words per text, each word spelled with `SPELLED` bits, and the texts' halves."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    tables = word_ngrams.train(df)
    flat = np.full(kneser_ney.SYMBOLS**kneser_ney.ORDER, kneser_ney.STEPS, np.uint16)  # one bit a symbol
    bits = word_ngrams.bits(df, tables, flat, kneser_ney.STEPS, kneser_ney._grams)
    rows = df.select("text", word_ngrams.fold(F.col("text")).alias("fold"), F.xxhash64("text").alias("_key")).join(bits, "_key").collect()
    halves = {r["text"]: r["fold"] for r in df.select("text", word_ngrams.fold(F.col("text")).alias("fold")).collect()}
    return {r["text"]: r["_words"] for r in rows}, halves, tables


def test_bits_equal_plain_ones(found):
    bits, halves, tables = found
    tri = Counter()
    for t in TEXTS:
        words = ["<s>", "<s>", *WORD.findall(t or "")]
        for i in range(2, len(words)):
            tri[1 - halves[t], words[i - 2], words[i - 1], words[i]] += 1
    bi = Counter((m, b, c) for m, a, b, c in tri)
    uni = Counter((m, c) for m, b, c in bi)
    own3, weight3 = shares(tri, lambda g: g[:3])
    own2, weight2 = shares(bi, lambda g: g[:2])
    own1, weight1 = shares(uni, lambda g: g[:1])
    assert tables.own3.count() == len(tri) and tables.own2.count() == len(bi) and tables.own1.count() == len(uni)
    assert sorted(r[0] for r in tables.own3.select("own3").collect()) == pytest.approx(sorted(own3.values()))
    assert sorted(r[0] for r in tables.weight2.select("weight2").collect()) == pytest.approx(sorted(weight2.values()))
    for t in TEXTS:
        words, m, total = WORD.findall(t or ""), halves[t], 0.0
        if not words:
            assert t not in bits
            continue
        starts = [x.start() for x in WORD.finditer(t)] + [len(t)]
        padded = ["<s>", "<s>", *words]
        spelled = {}  # what follows a word may be one character or none: a text's equal n-grams share the mean
        for i in range(len(words)):
            spelled.setdefault(tuple(padded[i : i + 3]), []).append(starts[i + 1] - starts[i])
        for i in range(len(words)):
            a, b, c = gram = tuple(padded[i : i + 3])
            p = 2.0 ** -(sum(spelled[gram]) / len(spelled[gram]))
            p = own1.get((m, c), 0) + weight1.get((m,), 1) * p
            p = own2.get((m, b, c), 0) + weight2.get((m, b), 1) * p
            total -= math.log2(own3.get((m, a, b, c), 0) + weight3.get((m, a, b), 1) * p)
        assert bits[t] == pytest.approx(total)


def test_shares_of_a_context_sum_to_one(found):
    tables = found[2]
    left = tables.weight3.agg(F.count("*").alias("n"), F.sum("weight3").alias("s")).first()
    assert tables.own3.agg(F.sum("own3")).first()[0] + left["s"] == pytest.approx(left["n"])
