"""Secrets by fixed patterns and by two character Markov models.  DataFrame functions only.

The patterns find assigned secrets, access keys and long hex strings.  Their
values are the labelled samples of random strings, long words that no pattern
touches those of ordinary identifiers.  First-order transition counts of both,
over all documents, give two Markov models; a long string whose characters the
random model explains better by enough bits each is a secret as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.session import cut

# The base patterns, in the order in which spans are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run never becomes longer
HEX = r"[0-9a-f]{24,}"  # a run of 24 or more; shorter runs are dropped
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"  # strings the models compare; also what the samples are cut into
MIN_BITS = 0.5  # per character, in favour of the random model
SYMBOLS = 128  # ASCII
SMOOTH = 0.5  # added to each transition


SPANS = "array<struct<start:int,stop:int,kind:int,value:string>>"
CHUNK = 256  # elements of an array scanned before its results are put to those before


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where lambda functions use it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scanned(array: Column, zero: Column, step: Callable[[Column, Column], Column], element: str) -> Column:
    """The outputs of a running state over an array: step(state, x) is struct(state, out); out is of type `element`.

    Results of a chunk are gathered by themselves: adding each to one long array would copy that every time.
    """
    none = F.array().cast(f"array<{element}>")

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return _let(F.aggregate(part, start, one), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(zero.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
        return F.flatten(F.aggregate(parts, begin, chunk)["out"])

    return F.when(F.size(array) > 0, _let(array, whole)).otherwise(none)


def _places(text: Column, pattern: str, kind: str) -> Column:
    """array<start, end, kind, value> of the leftmost non-overlapping matches, in code points.

    The pieces between matches tell where they are: a match starts after all
    earlier pieces and matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = _let(found, lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, g: F.struct(x.alias("m"), g.alias("g"))))

    def add(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        stop = start + F.length(x["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("value"))
        return F.struct(stop.alias("state"), span.alias("out"))

    return _scanned(steps, F.lit(0), add, SPANS[6:-1])


def _outside(words: Column, base: Column) -> Column:
    """The words that no base span touches; both are sorted by start.

    Seen from the front, a base span before a word reaches into it if the furthest
    end so far lies behind the word's start; seen from the back, one after it begins before the word's end.
    """
    markov = KINDS.index("markov")
    far = F.lit(1 << 30)

    def forward(reach: Column, x: Column) -> Column:
        free = F.when((x["kind"] != markov) | (reach <= x["start"]), x)
        return F.struct(F.when(x["kind"] != markov, F.greatest(reach, x["stop"])).otherwise(reach).alias("state"), free.alias("out"))

    def backward(next_: Column, x: Column) -> Column:
        free = F.when((x["kind"] == markov) & (x["stop"] <= next_), x)
        return F.struct(F.when(x["kind"] != markov, x["start"]).otherwise(next_).alias("state"), free.alias("out"))

    both = F.array_sort(F.concat(base, words))
    ahead = F.filter(_scanned(both, F.lit(0), forward, SPANS[6:-1]), lambda x: x.isNotNull())
    behind = F.filter(_scanned(F.reverse(ahead), far, backward, SPANS[6:-1]), lambda x: x.isNotNull())
    return F.when((F.size(words) == 0) | (F.size(base) == 0), words).otherwise(F.reverse(behind))


def _base_spans(documents: DataFrame) -> DataFrame:
    """`doc_id, text, base`"""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long_enough = F.filter(
        _places(text, ASSIGN, "assign"),
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE,
    )
    # Most texts have no such word or run at all; these tests are much cheaper than finding places.
    assign = F.when(text.rlike(r"(?i)password|passwd|secret|token|api_?key"), long_enough)
    access = F.when(F.contains(text, F.lit("AKIA")), _places(text, ACCESS, "access"))
    hexes = F.when(text.rlike(HEX), _places(text, HEX, "hex"))
    empty = F.array().cast(SPANS)
    spans = F.array_sort(F.concat(*[F.coalesce(c, empty) for c in (assign, access, hexes)]))
    return own.withColumn("base", spans)


def _candidates(text: Column) -> Column:
    return F.when(text.rlike(CANDIDATE), _places(text, CANDIDATE, "markov")).otherwise(
        F.array().cast(SPANS)
    )


def _transitions(samples: DataFrame) -> DataFrame:
    """`random (boolean), pair (of characters), n` from `random, value`."""
    chars = F.split("value", "")
    pairs = _let(chars, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))
    return samples.where(F.length("value") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def _ratios(counts: DataFrame) -> list[float]:
    """Bits in favour of the random model by 128 a + b; at most 128 * 128 pairs are gathered."""
    n = {True: {}, False: {}}
    for row in counts.where(F.col("pair").rlike(r"^[\x21-\x7e]{2}$")).collect():
        a, b = row["pair"]
        n[row["random"]][ord(a), ord(b)] = row["n"]
    used = sorted({c for side in n.values() for pair in side for c in pair})
    out = [0.0] * (SYMBOLS * SYMBOLS)
    for a in used:
        totals = {kind: sum(n[kind].get((a, b), 0) + SMOOTH for b in used) for kind in n}
        for b in used:
            p, q = ((n[kind].get((a, b), 0) + SMOOTH) / totals[kind] for kind in (True, False))
            out[a * SYMBOLS + b] = math.log2(p / q)
    return out


def train(spans: DataFrame) -> list[float]:
    """From `base, outside` of all documents: the values of base spans against the words outside them."""
    # Of an assignment the value counts, without the name before it.
    assigned = lambda s: F.when(s["kind"] == KINDS.index("assign"), F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])
    values = F.transform("base", assigned)
    random = spans.select(F.lit(True).alias("random"), F.explode(values).alias("value"))
    plain = spans.select(F.lit(False).alias("random"), F.explode(F.transform("outside", lambda w: w["value"])).alias("value"))
    return _ratios(cut(_transitions(random.unionByName(plain)), "transitions"))


def _bits(value: Column, table: Column) -> Column:
    """Sum of the log ratios over the characters' transitions."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    one = lambda a, b: F.element_at(table, a * SYMBOLS + b + 1)
    steps = _let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), one))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def secrets(documents: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, n_markov, base, spans` per document.

    base, spans: arrays of (start, stop, kind, value) by start, then kind; places
    in code points, stop exclusive.  spans are the base ones and those strings of
    16 or more letters, digits and +/_=- outside them that the random model
    prefers by `min_bits` a character.  A null text is empty and has none.  Every
    row gives one row; other columns are ignored.  Without any base span nothing
    is known of random strings, and the method adds none.
    """
    found = _base_spans(documents).withColumn("words", _candidates(F.col("text"))).drop("text")
    found = cut(found.select("doc_id", "base", _outside(F.col("words"), F.col("base")).alias("outside")), "secret-spans")
    ratios = train(found)
    known = any(ratios)
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    extra = F.filter("outside", lambda w: F.lit(known) & (_bits(w["value"], table) >= min_bits * (F.length(w["value"]) - 1)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    out = found.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))
    return out.select("doc_id", *[count(k) for k in KINDS[:3]], (F.size("spans") - F.size("base")).cast("long").alias("n_markov"), "base", "spans")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
