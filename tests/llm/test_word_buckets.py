"""Lookups of words go in rounds of packed n-grams; what a round takes on disk is a small, bounded share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskline.llm import kneser_ney, word_ngrams

FLAT = np.full(kneser_ney.SYMBOLS**kneser_ney.ORDER, kneser_ney.STEPS, np.uint16)  # one bit a symbol


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    made = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(60)] + ["", None, "x", "x y"]
    return spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(made)], "text string, _trusted boolean")


def looked_up(df, tables):
    return {r["_key"]: r["_words"] for r in word_ngrams.bits(df, tables, FLAT, kneser_ney.STEPS, kneser_ney._grams).collect()}


def test_rounds_hold_every_gram_once_in_few_bytes(spark, texts):
    shared = spark.sparkContext.broadcast(FLAT.tobytes())
    rows = texts.select(F.xxhash64("text").alias("_key"), word_ngrams.fold(F.col("text")).alias("fold"), "text", F.lit(3).alias("use"))
    dealt = [
        word_ngrams._dealt(rows, word_ngrams._LOOKED_UP, 4, (k, word_ngrams.ROUNDS), shared, kneser_ney.STEPS, kneser_ney._grams).agg(F.sum("n").alias("n"), F.sum(F.length("data")).alias("size")).first()
        for k in range(word_ngrams.ROUNDS)
    ]
    total = sum(r["n"] for r in dealt)
    assert 60 * 399 <= total <= 60 * 400 + 3  # random words: hardly an n-gram comes twice in a text
    assert max(r["n"] for r in dealt) < 0.3 * total
    assert sum(r["size"] for r in dealt) < 48 * total  # before compression, which takes the zeros


def test_rare_words_and_marked_texts_give_the_same_bits(spark, texts, monkeypatch):
    tables = word_ngrams.train(texts.where("_trusted"))
    usual = looked_up(texts, tables)
    assert len(usual) == 62
    assert looked_up(texts.select("text"), tables) == pytest.approx(usual)  # trusted texts dealt beside the documents
    monkeypatch.setattr(word_ngrams, "BROADCAST_IDS", 500)
    assert word_ngrams._common(tables.words)[2].count() > 500
    assert looked_up(texts, tables) == pytest.approx(usual)


def test_a_copy_of_a_trusted_text_is_not_counted(spark, texts):
    """Which rows are trusted decides, not which texts."""
    more = texts.union(texts.where("_trusted").withColumn("_trusted", F.lit(False)))
    tables = word_ngrams.train(texts.where("_trusted"))
    assert looked_up(more, tables) == pytest.approx(looked_up(texts, tables))
