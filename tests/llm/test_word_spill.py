"""A bucket of n-grams is counted and looked up in bounded memory, however common its middle word is."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from deskline.llm import kneser_ney, word_ngrams

FLAT = np.full(kneser_ney.SYMBOLS**kneser_ney.ORDER, kneser_ney.STEPS, np.uint16)  # one bit a symbol


def looked_up(df, tables):
    return {r["_key"]: r["_words"] for r in word_ngrams.bits(df, tables, FLAT, kneser_ney.STEPS, kneser_ney._grams).collect()}


def test_spilled_buckets_give_the_same_bits(spark, monkeypatch):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    made = [" ".join(rng.choice(["the", "of", rng.choice(words)]) for _ in range(300)) for _ in range(60)] + ["", None, "the"]
    texts = spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(made + made[:5])], "text string, _trusted boolean")
    trusted = texts.where("_trusted")
    tables = word_ngrams.train(trusted)
    usual = looked_up(texts, tables)
    names = ("own3", "weight3", "own2", "weight2")
    shares = {k: sorted(r[0] for r in getattr(tables, k).collect()) for k in names}
    for most in (2000, 100):  # some of the buckets, all of them
        monkeypatch.setattr(word_ngrams, "HELD", most)
        spilled = word_ngrams.train(trusted)
        assert spilled.discounts == tables.discounts
        assert {k: sorted(r[0] for r in getattr(spilled, k).collect()) for k in names} == {k: pytest.approx(v) for k, v in shares.items()}
        assert sorted(spilled.words.collect()) == sorted(tables.words.collect())
        assert looked_up(texts, spilled) == pytest.approx(usual)
        assert looked_up(texts.select("text"), spilled) == pytest.approx(usual)


def test_a_common_middle_word_takes_bounded_memory():
    rng = np.random.default_rng(7)
    n, rows = 50_000, 60
    schema = word_ngrams.arrow_schema(word_ngrams._PACKED)

    def batches():
        for source in range(rows):
            columns = {
                "w2": np.full(n, 77, np.uint64),
                "w1": rng.integers(0, 2000, n).astype(np.uint64),
                "w3": rng.integers(0, 2000, n).astype(np.uint64),
                "n": np.ones(n, np.uint32),
                "text": rng.integers(0, 1000, n).astype(np.uint32),
                "spelled": np.full(n, 9000),
            }
            texts = (np.arange(1000, dtype=np.uint64), np.ones(1000, np.uint64), np.full(1000, 3, np.uint64))
            yield from word_ngrams._batches(word_ngrams._packed(1, source, word_ngrams._LOOKED_UP, columns, texts), schema)

    tracemalloc.start()
    most = 1 << 17
    bucket = word_ngrams._Bucket(batches(), most)
    ctx, bi, times = bucket.counts([0.5, 1.0, 1.5])
    size = 0
    for lo, hi in bucket.ranges:
        assert len(bucket.seen(lo, hi)[0]) <= most
        size += len(bucket.asked.read(lo, hi)["n"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == n * rows and ctx[2].sum() == n * rows
    assert bi[3].sum() <= 2000 * 2000 and len(bucket.ranges) > 20
    assert peak < 60 << 20  # held at once, n-grams and their hashes alone would be over 200 MB


def test_texts_go_to_python_in_batches_of_few_bytes(spark):
    from deskline.session import ARROW_BYTES, freed

    df = spark.range(0, 600, 1, 1).selectExpr("repeat('ab ', 20000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with freed(spark):
        assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 1.5 * ARROW_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_words_of_any_length_have_hashes_of_their_own():
    rng = random.Random(5)
    made = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in [*range(1, 80), 200, 500] for _ in range(4)})
    texts = [" ".join(rng.sample(made, len(made))) for _ in range(3)]
    grams = word_ngrams._grams(pa.array(texts))
    hashes = {}
    for owner, words in enumerate(t.split() for t in texts):
        for word, h in zip(words, grams.w3[grams.owner == owner].tolist(), strict=True):
            assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes) == len(made)


def test_parts_that_are_summed_up_are_taken_away(spark):
    from deskline.session import cut, removed

    one, other = cut(spark.range(5), "part"), cut(spark.range(7), "part")
    folder = one.inputFiles()[0].rpartition("/")[0]
    removed(one)
    assert other.count() == 7
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
