"""Repeated passages against a brute-force version."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute

from deskline.llm import recompression
from deskline.llm.words import words_of


def texts(seed, words, passage):
    """Documents that share passages, copies and near copies, runs of a word and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 3)))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(passage), fresh(2 * passage), fresh(passage - 1)]
    docs = [fresh(words) + s + fresh(rng.randint(0, words)) for s in shared for _ in range(3)]
    docs += [s + fresh(3) for s in shared] + [fresh(3) + s for s in shared]
    near = fresh(4 * passage)
    for _ in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = word()
        docs.append(copy)
    docs += [near, near, ["x"] * (3 * passage), ["x"] * (2 * passage) + ["y"], ["x", "y"] * passage, ["y", "x", "y"] * passage, shared[0] * 3]
    rng.shuffle(docs)
    return [rng.choice(["", " "]) + rng.choice([" ", "\n", " \t "]).join(d) for d in docs]


@pytest.mark.parametrize(("seed", "size"), [(1, 50), (2, 50), (3, 6), (5, 8), (4, 1)])
def test_equals_brute_force(spark, seed, size):
    rng = random.Random(seed)
    docs = [(rng.randrange(25), t) for t in texts(seed, 2 * size, size + 3)]
    docs += [(None, docs[0][1]), (99, docs[0][1]), (98, None), (97, ""), (96, " \n "), (95, "é日本 " * 60), (94, "é日本 " * 55)]
    rows = [(n, i, t, "a", 7) for n, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "n int, doc_id long, text string, gone string, n_words int").repartition(5)
    got = {r["n"]: r for r in recompression.without_repeats(df, size).collect()}
    assert got[0].__fields__ == ["n", "doc_id", "text", "gone", "n_words", "n_removed"]
    assert [(got[n]["n_words"], got[n]["n_removed"], got[n]["text"] or "") for n in range(len(docs))] == brute.without_repeats(docs, size)
    assert [got[n]["text"] is None for n in range(len(docs))] == [t is None for _, t in docs]
    assert all(got[n]["gone"] == "a" for n in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert recompression.without_repeats(df).collect() == []


@pytest.mark.parametrize("size", [4, 6, 11, 50])
def test_equal_windows_have_one_symbol(size):
    for seed in range(15):
        words = words_of(pa.array(texts(seed, 80, size + 8)))
        found = recompression.stretches(words, size)
        symbols = {}
        for start, stop, symbol in zip(found.start, found.stop, found.symbol):
            for i in range(start, stop):
                assert symbols.setdefault(tuple(words.hash[i : i + size]), symbol) == symbol
        assert sum(found.stop - found.start) == sum(np.maximum(np.diff(words.first) - size + 1, 0))


def test_a_long_text(spark):
    """A text of 300,000 words twice: the second goes, whatever its length."""
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 1000, 300_000)))
    df = spark.createDataFrame([(1, text), (2, "a " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in recompression.without_repeats(df).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["text"]) == (0, 300_000, "a")
