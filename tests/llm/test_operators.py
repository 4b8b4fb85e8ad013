"""Operators against brute force, on small tables with every awkward case."""

import collections
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm import brute

from deskline.llm import best_fit, compression_rules, decontaminate, kneser_ney, license_rules, line_blocks, line_runs, ngram_join, secret_models, toxic_segments
from deskline.llm import queries as Q

VOCABULARY = ["alpha", "Beta", "gamma", "dé", "e", "fox", "go", "hat", "ink", "jar", "kit", "Log", "map", "ÑU", "x1"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, text_key long, component string, _doc string, hashes string"


def texts():
    """Near copies, exact copies, shared lines, empty, null, one word, very long."""
    rng = random.Random(7)
    long = lambda n: " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))
    base = long(60)
    out = [base] * 4
    for _ in range(30):  # near copies of one text, with one or two other words
        w = base.split(" ")
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
        out.append(" ".join(w))
    out += [long(n) for n in (1, 2, 4, 5, 6, 30, 90)]
    shared = "This whole line is shared by many documents"
    out += [f"{long(20)}\n{shared}\n{long(9)}\n \t{shared.upper()} " for _ in range(6)]
    out += [None, "", " \n\t", "\n\n", "word", "Fox", " fox ", long(5000), long(5000)]
    out.append(out[-1] + " tail")
    out += ["ab " * 300, "<p> || ## $$ &&"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, 0, "c", "d", "h") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def pairs():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_near_duplicates(docs, pairs):
    found = ngram_join.similar_documents(docs, common_from=2)
    assert rows(found, "n_shingles", "component_id") == brute.groups(pairs)
    assert rows(ngram_join.similar_documents(docs), "n_shingles", "component_id") == brute.groups(pairs)


def test_near_duplicates_random_sets(spark):
    rng = random.Random(3)
    out = []
    for _ in range(12):
        base = [rng.choice("abcdef") for _ in range(rng.randrange(5, 40))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            out.append(" ".join(w))
    pairs = list(enumerate(out))
    found = ngram_join.similar_documents(spark.createDataFrame(pairs, "doc_id long, text string"), common_from=1)
    assert rows(found, "n_shingles", "component_id") == brute.groups(pairs)


def test_near_duplicates_about_the_threshold(spark):
    # One text, 0 to 7 of its 130 words changed: pairs on both sides of the threshold, nearly all shingles common.
    draw = random.Random(11)
    base = [f"w{i}" for i in range(130)]
    pairs = []
    for i in range(240):
        words = list(base)
        for place in draw.sample(range(130), draw.randrange(8)):
            words[place] = f"x{draw.randrange(400)}"
        pairs.append((i, " ".join(words)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    # Rows without id that hold the same prefixes, some before and some after.
    df = df.withColumn("doc_id", F.lit(None).cast("long")).unionByName(df).repartition(3, "text")
    found = ngram_join.similar_documents(df).where("doc_id is not null")
    expected = brute.groups(pairs)
    assert rows(found, "n_shingles", "component_id") == expected
    assert 1 < len({c for _, c in expected.values()}) < 200


def test_parity_sketches_never_exclude_similar_sets(spark):
    draw = random.Random(5)
    data = []
    for _ in range(60):
        size, differ = draw.randrange(1, 3000), draw.random() * 0.4
        x = [draw.getrandbits(64) for _ in range(size)]
        y = [draw.getrandbits(64) if draw.random() < differ else h for h in x]
        sketches = ngram_join._sketches(np.array(x + y, np.uint64), np.repeat([0, 1], size), 2).view(np.int64).reshape(2, -1).tolist()
        both = len(set(x) & set(y))
        data.append((size, *sketches, 100 * both >= 75 * (2 * size - both)))
    df = spark.createDataFrame(data, "n long, s array<long>, t array<long>, similar boolean")
    may = df.withColumn("may", ngram_join._may_overlap(F.col("n"), F.col("n"), F.col("s"), F.col("t"), 75))
    assert may.where("similar and not may").count() == 0
    assert may.where("similar").count() > 5 and may.where("not may").count() > 5


def test_near_duplicates_repeated_and_null_ids(spark, empty):
    same = "one two three four five six"
    df = spark.createDataFrame([(5, same), (5, same), (None, same), (3, same), (9, "")], "doc_id long, text string")
    found = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in ngram_join.similar_documents(df).collect())
    assert found == [("3", 2, "3"), ("5", 2, "3"), ("5", 2, "3"), ("9", 0, "9"), ("None", 2, "None")]
    assert ngram_join.similar_documents(empty).count() == 0
    kept = ngram_join.first_of_each_group(df)
    assert kept.columns == df.columns and sorted(repr(r[0]) for r in kept.collect()) == ["3", "9", "None"]


def test_word_rules(docs, pairs, empty):
    found = compression_rules.judged(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(found, *names) == {i: brute.word_rules(t) for i, t in pairs}
    assert compression_rules.judged(empty).count() == 0


def test_compression_bands():
    compressor = compression_rules.zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    prose = " ".join(rng.choice(VOCABULARY) + rng.choice(["", "s", "ing", "er"]) + rng.choice(VOCABULARY) for _ in range(1000)).encode()
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000)).encode()
    assert compression_rules._bands(compressor, prose)[2]
    assert not compression_rules._bands(compressor, noise)[2]
    assert not compression_rules._bands(compressor, b"again and " * 900)[2]
    half = prose * 1 + b"again and " * 900  # whole ratio passes or not, the chunks tell
    assert not compression_rules._bands(compressor, half)[2]
    assert compression_rules._bands(compressor, b"") == (None, 0.0, True)
    size = compression_rules.CHUNK
    for length in (1, size // 2 - 1, size // 2, size, size + 1, size + size // 2 - 1, size + size // 2, 3 * size - 1, 3 * size + 5):
        seen = []
        probe = type("Probe", (), {"compress": lambda self, data: seen.append(len(data)) or b"x" * (len(data) // 2)})()
        compression_rules._bands(probe, b"a" * length)
        judged = seen[1:]  # after the whole text
        assert sum(judged) == (length if 2 * length >= size else 0) and all(size <= 2 * n < 3 * size for n in judged)


def test_segments_are_maximal():
    assert toxic_segments.maximal_segments([], []) == []
    found = toxic_segments.maximal_segments([0, 1, 5, 100, 101], [1.0, 2.0, 1.0, 3.0, 3.0], drift=0.1)
    assert [(a, b) for a, b, _ in found] == [(0, 5), (100, 101)]
    assert found[0][2] == pytest.approx(4.0 - 0.3)
    rng = random.Random(5)
    for _ in range(50):  # against the definition: best interval first, then left and right of it
        n = 30
        s = [rng.choice([-1.0, -0.5, 2.0, 1.0]) for _ in range(n)]
        flat = [x if x > 0 else -0.7 for x in s]
        want = []

        def split(a, b):
            best = max(((sum(flat[i : j + 1]), -(j - i), -i) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                split(a, i)
                want.append((i, j))
                split(j + 1, b)

        split(0, n)
        places = [i for i, x in enumerate(flat) if x > 0]
        got = [(a, b) for a, b, _ in toxic_segments.maximal_segments(places, [flat[i] for i in places], 0.7)]
        assert sum(sum(flat[a : b + 1]) for a, b in got) == pytest.approx(sum(sum(flat[a : b + 1]) for a, b in want))


def test_toxicity_learns_and_holds_out(spark, docs, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    made, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["badone", "Badtwo!", "badthree,"])
        made.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    made += [(9001, ""), (9002, None)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9001, 1, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxic_segments.scored(df, lab).collect()}
    assert len(found) == len(made)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(lab_[2], found[lab_[0]]["predicted"]) for lab_ in labels if found[lab_[0]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert 0 <= found[9002]["score"] < 0.5 and found[9001]["score"] == found[9002]["score"]
    assert toxic_segments.scored(empty, lab.where(F.lit(False))).count() == 0
    assert toxic_segments.scored(df, lab.where(F.lit(False))).count() == len(made)


def test_licences(spark, empty):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted.\nRedistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice."
    cases = {
        "Foo bar.\nLicensed under the Apache License, Version 2.0. More": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.": "MIT,CC-BY-NC-4.0",
        bsd: "BSD-2-Clause",
        bsd + "\nNeither the name of X nor those of others may be used to endorse products.\nNo warranty.": "BSD-3-Clause",
        "The licence of a driver.": "",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in license_rules.licences(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert license_rules.licences(empty).count() == 0


def test_native_operators_run_no_python(spark, docs):
    for df in (license_rules.licences(docs), secret_models.secrets(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality_rejects_what_trusted_text_is_not(spark, docs, empty):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["the", "of", "and"]) + " " + rng.choice(["reading", "house", "thing", "water"]) for _ in range(120))
    noise = lambda: " ".join("".join(rng.choice("#$%QXZ|*") for _ in range(7)) for _ in range(80))
    made = [(i, prose() if i % 5 else noise(), "en" if i % 2 else None) for i in range(200)] + [(900, None, "en"), (901, "", "xx")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumns({"median": F.lit("m"), "_lang": F.lit(1), "row": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = rows(kneser_ney.quality(df, labels), "kept")
    assert all(kept[i][0] == bool(i % 5) for i in range(200)) and kept[900][0] and kept[901][0]
    assert len(kept) == len(made)
    stage = kneser_ney.of_good_quality(df, labels)
    assert stage.columns == df.columns and {r["doc_id"] for r in stage.collect()} == {i for i, k in kept.items() if k[0]}
    assert all(k[0] for k in rows(kneser_ney.quality(df, labels.where(F.lit(False))), "kept").values())
    assert kneser_ney.quality(empty, labels).count() == 0


def test_model_is_a_distribution(docs):
    model = kneser_ney.train(docs)
    p = 2.0 ** -(model.astype(float) / kneser_ney.STEPS)
    assert abs(p.reshape(-1, kneser_ney.SYMBOLS).sum(axis=1) - 1).max() < 0.01


def test_secrets(spark, pairs, empty):
    hexes = "0123456789abcdef" * 2
    extra = [
        f'token = "{hexes}" x password:abc Secret=token=abcdef API_KEY : \'zzzzzz\'',
        "AKIA" + "A1" * 8 + " AKIAAKIA123 AKIA" + "Z" * 15,
        "é" * 5 + " passwd='äbcdef' apikey=abcdef" + "\U0001f600" + hexes,
        hexes * 50,
        "secret=token:abcdef1",
    ]
    made = pairs + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    found = secret_models.secrets(df).select("doc_id", secret_models.listed("base").alias("base"), secret_models.listed("spans").alias("spans"))
    for r in found.collect():
        want = brute.base_spans(dict(made)[r["doc_id"]])
        assert r["base"] == ",".join(want)
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert secret_models.secrets(empty).count() == 0


def test_markov_models_add_random_strings(spark):
    rng = random.Random(6)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    parts = ["user", "name", "table", "index", "from", "get", "value2", "item3", "x86", "v10", "list", "count", "node", "2nd", "utf8", "a1b"]
    named = lambda: "_".join(rng.choice(parts) for _ in range(6))
    made = [(i, f"token={rand(32)} {named()} {named()}") for i in range(400)]
    made += [(1000, f"loose {rand(40)} string"), (1001, named())]
    found = rows(secret_models.secrets(spark.createDataFrame(made, "doc_id long, text string")), "n_markov")
    assert found[1000] == (1,) and found[1001] == (0,)


def test_packing(docs, pairs, empty):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    found = best_fit.packed_documents(docs, path, capacity=256, open_bins=4).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in pairs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        cuts = [(k // 256, k, ids[k : k + 256]) for k in range(0, len(ids), 256)]
        assert sorted(by_doc[i]) == [(p, s, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for p, s, x in cuts]
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 1.1 * total / 256 + 2
    assert best_fit.packed_documents(empty, path).count() == 0


def test_packer_closes_the_fullest():
    packer = best_fit.Packer(10, 2)
    assert [packer.add(0, 7), packer.add(1, 8), packer.add(2, 3)] == [None, None, [0, 2]]
    assert packer.add(3, 5) is None  # opens beside 8
    assert packer.add(4, 6) == [1]  # neither 2 nor 5 free: the bin with 8 closes
    assert packer.add(5, 10) == [5]
    assert sorted(packer.rest()) == [[3], [4]]


def test_repeated_lines(docs, pairs, empty):
    found = line_runs.without_repeated_lines(docs)
    assert found.columns == docs.columns + ["n_lines", "n_dropped"]
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    assert rows(found.select("doc_id", "n_lines", "n_dropped", digest), "n_lines", "n_dropped", "sha") == brute.kept_lines(pairs)
    assert line_runs.without_repeated_lines(empty).count() == 0


def test_repeated_lines_of_repeated_rows(spark):
    line = "a line that is longer than twenty"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (7, f"{line}\n{line}")], "doc_id long, text string")
    found = sorted((repr(r["doc_id"]), r["n_dropped"]) for r in line_runs.without_repeated_lines(df).collect())
    assert found == [("1", 1), ("1", 1), ("2", 1), ("7", 0), ("None", 1)]


def test_decontamination(spark, docs, pairs, empty):
    all_texts = dict(pairs)
    words = all_texts[38].split(" ")
    items = [(1, " ".join(words[5:25])), (2, "Fox"), (3, None), (4, " , "), (10, " ".join(words[5:25])), (11, "hat jar kit"), (12, "fox")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "sha", "contaminated")
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    want = brute.hits(pairs, items)
    for block in (3, 1000):  # several blocks of windows, or one
        assert rows(decontaminate.contaminated(docs, bench, block_pairs=block).withColumn("sha", digest), *names) == want
    kept = decontaminate.without_contaminated(docs, bench, block_pairs=3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where(F.lit(False))).where("contaminated").count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    by_id = {r["page_id"]: r["html"] for r in pages.collect()}
    found = line_blocks.extracted(pages).collect()
    assert len(found) == len(by_id)
    assert all(r["text"] == brute.article(by_id[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in found)


def test_pages_of_other_shapes(spark):
    body = "".join(f"<p>Paragraph {i} has a good number of words in it, so that it counts as text.</p>\n" for i in range(4))
    cases = {
        None: "",
        "": "",
        "plain &amp; text": "plain & text",
        "<p>unclosed <b>bold": "unclosed bold",
        f"<header>Site</header><div class='menu'><a href=x>A</a></div><main><h1>T</h1>{body}<div id=comments>no</div></main><footer>f</footer>": None,
        f"<ul><li><a href=a>Home page</a></li></ul><div>{body}</div><div class='sidebar'>other</div><form>x<input></form>": None,
    }
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in line_blocks.extracted(df).collect()}
    paragraphs = "\n".join(f"Paragraph {i} has a good number of words in it, so that it counts as text." for i in range(4))
    want = [w if w is not None else ("T\n" if "<h1>" in h else "") + paragraphs for h, w in cases.items()]
    assert [got[i] for i in range(len(cases))] == want
