"""Secrets by the Markov models against a plain version; long texts in linear time."""

import math
import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm import brute

from deskline.llm import secret_models


def plain(docs):
    """doc -> all spans, by the definition: base spans train the random model, other long words the ordinary one."""
    pairs, rest = {True: Counter(), False: Counter()}, {}

    def count(kind, value):
        pairs[kind].update(p for p in zip(value, value[1:]) if all("!" <= c <= "~" for c in p))

    for i, text in docs:
        text = text or ""
        base = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in brute.base_spans(text))]
        for a, b, kind in base:
            value = text[a:b]
            count(True, re.search(secret_models.ASSIGN, value, re.A)[2] if kind == "assign" else value)
        words = [m.span() for m in re.finditer(secret_models.CANDIDATE, text)]
        free = [(a, b) for a, b in words if not any(s < b and a < e for s, e, _ in base)]
        for a, b in free:
            count(False, text[a:b])
        rest[i] = (text, base, free)
    used = sorted({c for k in pairs for p in pairs[k] for c in p})
    total = {k: {a: sum(pairs[k][a, b] + secret_models.SMOOTH for b in used) for a in used} for k in pairs}
    out = {}
    for i, (text, base, free) in rest.items():
        found = [(a, secret_models.KINDS.index(kind), kind, b) for a, b, kind in base]
        for a, b in free:
            bits = 0.0
            for p in zip(text[a:b], text[a + 1 : b]):
                if p[0] in total[True] and p[1] in total[True]:
                    share = [(pairs[k][p] + secret_models.SMOOTH) / total[k][p[0]] for k in (True, False)]
                    bits += math.log2(share[0] / share[1])
            if any(pairs[True].values()) and bits >= secret_models.MIN_BITS * (b - a - 1):
                found.append((a, 3, "markov", b))
        out[i] = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return out


def test_all_spans_equal_plain_ones(spark):
    rng = random.Random(2)
    secret = lambda n=24: "".join(rng.choices("BCDEFGHJLMNPRSTUVW", k=n))
    made = [(1000 + i, f"é token={secret()}== secret:{secret()} password={secret(60)} longidentifiername_{i % 7} AKIA{'Q' * 16}, {'pass ' + secret(40) if i < 10 else ''} {string.ascii_letters + string.digits}") for i in range(100)]
    made += [(2000, "token=abcdef" * 60), (2001, "password: aaaaaaaaaaaaaaaaaaaaaaaa=bb" + " x" * 300), (2002, None), (2003, "")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + made
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"base": F.lit("x"), "outside": F.lit(1)})
    got = secret_models.secrets(df).select("doc_id", secret_models.listed("spans").alias("s"), "n_markov").collect()
    want = plain(docs)
    assert {r["doc_id"]: r["s"] for r in got} == want
    assert sum(r["n_markov"] for r in got) == ",".join(want.values()).count("markov") >= 10


def test_long_texts_take_linear_time(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    run = "".join(rng.choices(string.ascii_letters, k=1_000_000))
    many = " ".join(word(18) for _ in range(50_000))
    both = " ".join(f"token={word(20)} {'a' * 17}" for _ in range(20_000))
    df = spark.createDataFrame([(1, run), (2, many), (3, both), (4, "password: abcdefgh")], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in secret_models.secrets(df).collect()}
    assert time.time() - start < 120  # quadratic work on any of them would take many minutes
    assert (got[3]["n_assign"], got[3]["spans"][-1]["start"]) == (20_000, both.rindex("token"))
