"""Quality must tell real words in senseless order from trusted text, and its model must grow with the text."""

import random

from pyspark.sql import functions as F

from deskline.llm import kneser_ney, word_ngrams


def test_senseless_order_is_rejected_and_tables_grow(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    after = {w: rng.sample(names, 3) for w in names}

    def sense(n=200):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    made = [(i, " ".join(sense()), "en") for i in range(200)]
    made += [(1000 + i, " ".join(rng.sample(w := sense(), len(w))), "en") for i in range(20)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kneser_ney.quality(df, labels).collect()}
    assert sum(kept[i] for i in range(200)) >= 195
    assert not any(kept[i] for i in range(1000, 1020))
    few, many = (word_ngrams.train(df.where(F.col("doc_id") < n)).own3.count() for n in (20, 120))
    assert many > 1.5 * few
