"""Repeated passages of a fixed number of words, found by recompression.

A word sequence is shortened in rounds.  A round of pairs splits the symbols in
two classes by a hash of their name and replaces each symbol of the first class
that stands before one of the second by one symbol for both; some rounds first
replace every run of one symbol by one symbol for the run.  A new symbol's name
is a hash of what it replaces, so names are global without any table of names,
and equal passages get equal symbols wherever they stand, but for a few at their
ends.  With each symbol goes its context: the words that decided that this
symbol stands here.  A passage that holds all of the context has the symbol in
every document.

Every window of `size` words is given to one symbol whose context it holds: of
the highest level there is in it, the smallest name, the leftmost.  (The words
themselves are level 0, so there always is one.)  The consecutive windows given
to one symbol are a stretch.  Equal windows are given to the same symbol at the
same place, so only stretches with the same symbol can share a window:

1. Stretches are counted by symbol and words.  One that a smaller doc_id has as
   well is removed whole; inside a copied passage that is nearly all of it.
2. Where a symbol has several different stretches (the ends of copied passages),
   the first holder of each gives the hashes of its single windows, and these
   are compared the same way.

Only hashes of 128 bits travel, and back come lists of places per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskline.llm.frames import arrow_schema, mapped
from deskline.llm.words import Words, mix, slices, sums, words_of
from deskline.session import cut

SIZE = 50  # words in a window
ROUNDS = 5  # symbols are 4 words long on average after them, their contexts 13 to 20
RUN_ROUNDS = (0, 3)  # a round of runs widens all contexts by a symbol on both sides

UNPACKED = 1 << 24  # bytes of text unpacked at a time; one longer text is unpacked alone

_ODD = np.uint64(0x9E3779B97F4A7C15)
# A place is range * PLACES + window + 1, or range * PLACES for the whole stretch.
PLACES = 1 << 16


class Level(NamedTuple):
    """Symbols in text order; `low:high` are the words a symbol's being there depends on."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def levels(words: Words, rounds: int = ROUNDS, run_rounds: tuple[int, ...] = RUN_ROUNDS) -> list[Level]:
    """The symbols of all texts after each number of rounds.

    What depends on a text's end gets a context that reaches one word beyond it.
    """
    count = len(words.hash)
    text = np.repeat(np.arange(len(words.first) - 1, dtype=np.int32), np.diff(words.first))
    first = words.first.astype(np.int32)  # narrow numbers: these arrays are most of the work
    before, behind = first[:-1] - 1, first[1:] + 1
    found = [Level(words.hash, np.arange(count, dtype=np.int32), np.arange(1, count + 1, dtype=np.int32))]
    for number in range(rounds):
        name, low, high = found[-1]
        if number in run_rounds:
            name, low, high, text = _runs(name, low, high, text, before, behind)
        name, low, high, text = _pairs(name, low, high, text, before, behind, number)
        found.append(Level(name, low, high))
    return found


def _edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a symbol is the first, the last of its text."""
    change = text[1:] != text[:-1]
    one = np.ones(min(1, len(text)), bool)
    return np.concatenate([one, change]), np.concatenate([change, one])


def _runs(name, low, high, text, before, behind):
    first, _ = _edges(text)
    head = np.flatnonzero(first | np.concatenate([first[:1], name[1:] != name[:-1]]))
    length = np.diff(np.append(head, len(name)))
    tail = head + length - 1
    first, last = first[head], _edges(text)[1][tail]
    # That a run ends here is decided by the symbols on both sides.
    new_low = np.where(first, before[text[head]], low[np.maximum(head - 1, 0)])
    new_high = np.where(last, behind[text[head]], high[np.minimum(tail + 1, len(name) - 1)])
    new_name = np.where(length > 1, mix(name[head] + length.astype(np.uint64) * _ODD), name[head])
    return new_name, new_low, new_high, text[head]


def _pairs(name, low, high, text, before, behind, number):
    first, last = _edges(text)
    second = (mix(name + np.uint64(number * 7919 + 13)) >> np.uint64(63)).astype(bool)
    after = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
    ahead = np.maximum(np.arange(len(name)) - 1, 0)
    joined = ~second & second[after] & ~last
    # Symbols left alone: the first class looked at the next symbol, the second at the one before.
    new_high = np.where(joined | ~second, np.where(last, behind[text], high[after]), high)
    new_low = np.where(second, np.where(first, before[text], low[ahead]), low)
    new_name = np.where(joined, mix(name * np.uint64(3) + mix(name[after])), name)
    keep = np.ones(len(name), bool)
    keep[1:] = ~joined[:-1]
    return new_name[keep], new_low[keep], new_high[keep], text[keep]


class Stretches(NamedTuple):
    """Consecutive windows given to one symbol: windows `start:stop` (by first word) of text `text`.

    Stretches of one text with the same `symbol` and `words` have the same `number`; `chosen` is one row of each.
    """

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    symbol: np.ndarray
    words: np.ndarray
    number: np.ndarray
    chosen: np.ndarray


def _least(name: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The place of the smallest name in each range, the leftmost of equal ones; the ranges are not empty."""
    near = np.zeros(len(name) + 1, np.int64)
    np.add.at(near, start, 1)
    np.add.at(near, stop, -1)
    near = np.flatnonzero(np.cumsum(near[:-1]))  # only symbols in some range are looked at
    name = name[near]
    start, stop = np.searchsorted(near, start), np.searchsorted(near, stop - 1) + 1
    power = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int64)
    table = np.arange(len(name))
    for k in range(int(power.max(initial=0)) + 1):
        here = np.flatnonzero(power == k)
        left, right = table[start[here]], table[stop[here] - (1 << k)]
        out[here] = np.where(name[right] < name[left], right, left)
        if len(table) > 1 << k:
            left, right = table[: -(1 << k)], table[1 << k :]
            table = np.where(name[right] < name[left], right, left)
    return near[out]


def stretches(words: Words, size: int = SIZE, rounds: int = ROUNDS) -> Stretches:
    per_text = np.maximum(np.diff(words.first) - size + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    window = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + words.first[:-1][text]
    symbol = np.zeros(len(window), np.uint64)
    low, high = np.zeros((2, len(window)), np.int32)
    window = window.astype(np.int32)
    open_ = np.arange(len(window))
    for level in reversed(levels(words, rounds)):
        start = np.searchsorted(level.low, window[open_])
        stop = np.searchsorted(level.high, window[open_] + np.int32(size), side="right")
        there = start < stop
        now = open_[there]
        at = _least(level.name, start[there], stop[there])
        symbol[now], low[now], high[now] = level.name[at], level.low[at], level.high[at]
        open_ = open_[~there]
        if not len(open_):
            break
    new = np.ones(len(window), bool)
    new[1:] = (text[1:] != text[:-1]) | (symbol[1:] != symbol[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window)) - 1
    window = window.astype(np.int64)
    of_words = sums(words.hash)
    content = of_words(window[head], window[tail] + size)
    # A short symbol is frequent by chance; with its context, which the windows hold as well, it is not.
    symbol = mix(symbol[head] + of_words(low[head], high[head]))
    order = np.lexsort((content, symbol, text[head]))
    key = np.stack([text[head][order].astype(np.uint64), symbol[order], content[order]])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any(key[:, 1:] != key[:, :-1], axis=0)
    group = np.cumsum(fresh) - 1
    number = np.empty(len(order), np.int64)
    number[order] = group
    chosen = order[fresh]
    # Numbers start at 0 in each text.
    base = np.searchsorted(text[head][chosen], np.arange(len(per_text)))
    number -= base[text[head]]
    return Stretches(text[head], window[head], window[tail] + 1, symbol, content, number, chosen)


# Rows of a document are told apart by `row`, a hash of its text: doc_ids may repeat.
_STRETCH = "doc_id long, row int, number int, symbol long, words long"
_WINDOW = "doc_id long, row int, place long, h1 long, h2 long"


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts, column `text`, compressed for the way."""
    work = zstandard.ZstdCompressor(level=1)
    texts = [None if t is None else work.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
    yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with its texts as they were, at most UNPACKED bytes of them at a time."""
    work, at = zstandard.ZstdDecompressor(), batch.schema.get_field_index("text")
    packed = batch.column("text")
    sizes = [0 if not t.is_valid else zstandard.frame_content_size(t.as_buffer()) for t in packed]
    low = total = 0
    for high, size in enumerate([*sizes, UNPACKED]):
        if high > low and total + size > UNPACKED:
            texts = [None if t is None else work.decompress(t) for t in packed[low:high].to_pylist()]
            yield batch.slice(low, high - low).set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))
            low, total = high, 0
        total += size


def _listed(size: int, schema: pa.Schema, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        found = stretches(words_of(part.column("text")), size)
        row, one = found.text[found.chosen], found.chosen
        columns = [part.column("doc_id").take(pa.array(row)), part.column("row").take(pa.array(row))]
        columns += [pa.array(found.number[one].astype(np.int32)), _longs(found.symbol[one]), _longs(found.words[one])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _single(size: int, schema: pa.Schema, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The windows of the stretches whose numbers are listed in `open`."""
    for part in (p for b in _unpacked(batch) for p in slices(b, "text")):
        words = words_of(part.column("text"))
        found = stretches(words, size)
        lists = part.column("open")
        wanted = set(zip(np.repeat(np.arange(len(lists)), lists.value_lengths()).tolist(), lists.flatten().to_pylist(), strict=True))
        one = np.array([i for i in found.chosen.tolist() if (int(found.text[i]), int(found.number[i])) in wanted], np.int64)
        length = found.stop[one] - found.start[one]
        at = np.repeat(one, length)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        start = found.start[at] + offset
        row = pa.array(found.text[at])
        columns = [part.column("doc_id").take(row), part.column("row").take(row), _longs(found.number[at] * PLACES + offset + 1)]
        columns += [_longs(sums(words.hash)(start, start + size)), _longs(sums(mix(words.hash + _ODD))(start, start + size))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _cleared(size: int, name: str, schema: pa.Schema, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts without the places listed in the column `name`; all words stand one space apart."""
    for part in (p for b in _unpacked(batch) for p in slices(b, "text")):
        count = np.zeros(part.num_rows, np.int64)
        lost = np.zeros(part.num_rows, np.int64)
        kept = [None if t is None else t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
        gone = part.column(name)
        some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            words = words_of(part.column("text").take(pa.array(some)))
            found = stretches(words, size)
            edge = np.zeros(len(words.hash) + 1, np.int64)
            places = {i: set(x) for i, x in enumerate(gone.take(pa.array(some)).to_pylist())}
            for i, (text, number) in enumerate(zip(found.text.tolist(), found.number.tolist(), strict=True)):
                own, base = places[text], number * PLACES
                if base in own:
                    edge[found.start[i]] += 1
                    edge[found.stop[i] - 1 + size] -= 1
                elif (start := int(found.start[i])) < (stop := int(found.stop[i])):
                    for offset in range(stop - start):
                        if base + offset + 1 in own:
                            edge[start + offset] += 1
                            edge[start + offset + size] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            for k, row in enumerate(some.tolist()):
                stay = keep[words.first[k] : words.first[k + 1]]
                lost[row] = len(stay) - int(stay.sum())
                count[row] = lost[row]
                kept[row] = [w for w, s in zip(kept[row], stay.tolist(), strict=True) if s]
        count += np.array([len(w or ()) for w in kept], np.int64)
        texts = pa.array([None if w is None else b" ".join(w) for w in kept], pa.binary()).cast(pa.string())
        new = {"text": texts, "n_words": pa.array(count), "n_removed": pa.array(lost)}
        yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in schema.names], schema=schema)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with `text` cut down to the words that no smaller document's window covers.

    A window is `size` consecutive words of one text (words: runs without ASCII
    white space).  Every word goes that lies in a window whose word sequence is
    also in a document with a smaller doc_id; what is compared are the given
    texts.  Adds `n_words` (before) and `n_removed`; the kept words stand one
    space apart.  Columns with these names are replaced, others stay.

    Null text: stays null, no words.  Texts of fewer than `size` words, empty ones
    too, only lose extra white space.  Repeated doc_ids: their rows do not affect
    each other.  Null doc_id: has no place in the order, loses and removes nothing.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    placed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.hash("text").alias("row"))
    listed = cut(mapped(placed, partial(_listed, size, arrow_schema(_STRETCH)), _STRETCH), "stretches")
    hits = cut(_repeated(listed), "repeated")
    packed = mapped(placed, _packed, T.StructType([f if f.name != "text" else T.StructField("text", T.BinaryType()) for f in placed.schema]))
    lists = hits.where("open").groupBy("doc_id", "row").agg(F.collect_set("number").alias("open"))
    windows = cut(mapped(packed.join(lists, ["doc_id", "row"]), partial(_single, size, arrow_schema(_WINDOW)), _WINDOW), "windows")
    low = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top")
    single = windows.join(low.select("h1", "h2", "low"), ["h1", "h2"]).where("low < doc_id").select("doc_id", "row", "place")
    whole = hits.where(~F.col("open")).select("doc_id", "row", (F.col("number") * F.lit(PLACES).cast("long")).alias("place"))
    gone = whole.unionByName(single).groupBy("doc_id", "row").agg(F.collect_set("place").alias("gone"))
    name = "gone" + "_" * max(map(len, columns))  # no column of docs has this name
    marked = _row_joined(docs.select(*columns), gone, name)
    schema = T.StructType([f for f in docs.schema if f.name in columns and f.name != "text"])
    schema = schema.add("text", "string").add("n_words", "long", False).add("n_removed", "long", False)
    out = mapped(marked, partial(_cleared, size, name, to_arrow_schema(schema)), schema)
    return out.select(*columns, "n_words", "n_removed")


def _repeated(listed: DataFrame) -> DataFrame:
    """Stretches a smaller document has as well, and (`open`) the first holder's ones whose symbol has other stretches.

    Most symbols are in one document only and go first; of the others most have
    one stretch everywhere, whose first holder is that of the symbol.
    """
    symbols = listed.groupBy("symbol").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.min("words").alias("a"), F.max("words").alias("b")
    )
    shared = symbols.where("low < top").select("symbol", "low", (F.col("a") < F.col("b")).alias("mixed"))
    rows = cut(listed.join(shared, "symbol").where("mixed or low < doc_id"), "shared")
    same = rows.where("not mixed").select("doc_id", "row", "number", F.lit(False).alias("open"))
    several = rows.where("mixed").drop("low")
    first = several.groupBy("symbol", "words").agg(F.min("doc_id").alias("low"))
    held = several.join(first, ["symbol", "words"])
    return same.unionByName(held.select("doc_id", "row", "number", (F.col("low") == F.col("doc_id")).alias("open")))


def _row_joined(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs, texts compressed, with the list of places of their doc_id and text as a column of that name."""
    of = name + "of"
    keyed = docs.withColumn(of, F.struct("doc_id", F.hash("text").alias("row")))
    packed = mapped(keyed, _packed, T.StructType([f if f.name != "text" else T.StructField("text", T.BinaryType()) for f in keyed.schema]))
    return packed.join(gone.select(F.struct("doc_id", "row").alias(of), F.col("gone").alias(name)), of, "left").drop(of)
