"""Input columns that are called like an operator's outputs or working columns change nothing."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from deskline.llm import compression_rules, decontaminate, kneser_ney, license_rules, line_blocks, secret_models, toxic_segments

NAMES = {
    "op2": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3": ["held_out", "score", "predicted", "toxic", "token", "n"],
    "op4": ["licences", "identifiers", "n_sentences", "sentence", "sentences", "value"],
    "op5": ["n_symbols", "perplexity", "threshold", "kept", "row", "score_bits", "tri", "n"],
    "op6": ["n_assign", "n_access", "n_hex", "base", "spans", "kind", "start", "end"],
    "op9": ["n_words", "n_hit", "n_items", "items", "contaminated", "item_id", "place"],
    "op10": ["text", "n_chars", "line"],
}


def result(df, key):
    return sorted(map(repr, df.select(key, *sorted(c for c in df.columns if c != key)).collect()))


@pytest.mark.parametrize("op", NAMES)
def test_names_that_clash(spark, op):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    docs, labels, benchmark = (read(n) for n in ("documents", "labels", "benchmark"))
    docs = docs.where(F.col("doc_id") < 300)  # a small fixture
    work = {
        "op2": compression_rules.judged,
        "op3": lambda df: toxic_segments.scored(df, labels),
        "op4": license_rules.licences,
        "op5": lambda df: kneser_ney.quality(df, labels),
        "op6": secret_models.secrets,
        "op9": lambda df: decontaminate.contaminated(df, benchmark),
        "op10": line_blocks.extracted,
    }[op]
    key = "page_id" if op == "op10" else "doc_id"
    given = read("pages") if op == "op10" else docs
    clashing = given.withColumns({n: F.lit("other") for n in NAMES[op]})
    plain, got = work(given), work(clashing)
    assert result(got.select(*plain.columns), key) == result(plain, key)
