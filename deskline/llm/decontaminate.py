"""Benchmark passages in documents, by Wu-Manber multi-pattern search.

A pattern is a window of consecutive item words, written with single spaces
around it; a document is normalised in the same way, so an occurrence of the
words is an occurrence of the bytes.  Patterns of similar length share tables:
`shift` tells from the last BLOCK bytes of the current position how far no
pattern can end, a bucket of patterns with the same beginning is looked up where
it says nothing, and a comparison of all bytes confirms.

Patterns are dealt into blocks of bounded size by a hash; each block is
broadcast and searched for in all documents where they lie, so texts never move.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.frames import arrow_schema, mapped
from deskline.session import cut

WINDOW = 10  # words
BLOCK_PAIRS = 50_000  # (item, window) pairs searched for at once: the bound of a broadcast
BLOCK = 8  # bytes that decide a shift
MAX_SHIFT = 255  # a shift is one byte

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytearray(range(256))
for _c in _SEPARATORS:
    _NORMAL[_c] = 0x20
for _c in range(ord("A"), ord("Z") + 1):
    _NORMAL[_c] = _c + 32
_NORMAL = bytes(_NORMAL)


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of letters, digits and all beyond ASCII."""
    return text.translate(_NORMAL).split() if text else []


class Patterns:
    """Wu-Manber tables of some windows; built in the process that searches."""

    def __init__(self, items: dict[bytes, list[str]]):
        self.items = items
        by_class: dict[int, list[bytes]] = {}
        for window in items:
            by_class.setdefault((len(window).bit_length() - 1) // 2, []).append(window)
        self.classes = [self._tables(found) for found in by_class.values()]

    @staticmethod
    def _tables(windows: list[bytes]) -> tuple:
        least = min(map(len, windows))
        block = max(1, min(BLOCK, least // 2))
        most = min(MAX_SHIFT, least - block + 1)
        bits = max(12, (len(windows) * least * 4).bit_length())
        mask = (1 << bits) - 1
        shift = bytearray([most]) * (1 << bits)
        starts: dict[bytes, list[bytes]] = {}
        for window in windows:
            starts.setdefault(window[:least], []).append(window)
        for start in starts:
            for end in range(block, least + 1):
                at = hash(start[end - block : end]) & mask
                shift[at] = min(shift[at], least - end)
        return least, block, mask, bytes(shift), starts

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, window) of every occurrence."""
        for least, block, mask, shift, starts in self.classes:
            at, size = least, len(text)
            while at <= size:
                step = shift[hash(text[at - block : at]) & mask]
                if step:
                    at += step
                    continue
                for window in starts.get(text[at - least : at], ()):
                    if text.startswith(window, at - least):
                        yield at - least, window
                at += 1


_built: dict[str, Patterns] = {}


def _patterns(shared) -> Patterns:
    """The tables of a broadcast block, built once per process."""
    if shared.value[0] not in _built:
        _built.clear()
        _built[shared.value[0]] = Patterns(pickle.loads(shared.value[1]))
    return _built[shared.value[0]]


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """`item_id (string), window` once each."""

    def cut_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            parts = words(text)
            for i in range(max(1, len(parts) - size + 1) if parts else 0):
                ids.append(item)
                found.append(b" " + b" ".join(parts[i : i + size]) + b" ")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "window"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return mapped(named.where(F.col("item_id").isNotNull()), cut_up, "item_id string, window binary").distinct()


def _blocks(benchmark: DataFrame, window: int, block_pairs: int) -> Iterator:
    """Broadcasts of at most about `block_pairs` windows each; one at least."""
    pairs = cut(item_windows(benchmark, window), "windows")
    count = max(1, -(-pairs.count() // block_pairs))
    for number in range(count):
        block = pairs.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(count)) == number).toArrow()
        items: dict[bytes, list[str]] = {}
        for item, found in zip(block["item_id"].to_pylist(), block["window"].to_pylist()):
            items.setdefault(found, []).append(item)
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pickle.dumps(items)))


_FOUND = "doc_id long, text_key long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _finder(shared, all_rows: bool):
    schema = arrow_schema(_FOUND)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(shared)
        rows = []
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts):
            parts = words(text)
            normal = b" " + b" ".join(parts) + b" " if parts else b""
            found = list(patterns.search(normal))
            if found or all_rows:
                spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20) if found else None
                spans: list[list[int]] = []
                for place, size in sorted({(int(np.searchsorted(spaces, p)), w.count(b" ") - 1) for p, w in found}):
                    if spans and place <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], place + size)
                    else:
                        spans.append([place, place + size])
                items = sorted({item for _, w in found for item in patterns.items[w]})
                rows.append((doc, key, len(parts), [{"s": s, "e": e} for s, e in spans], items))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return find


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items, contaminated` per document.

    A document word is hit when it lies inside any occurrence of an item window;
    items are those with an occurring window, as sorted strings.  Null and empty
    texts have no words; items without words or without an id have no window.
    Rows that agree in doc_id and text are one document (one row); other rows
    stay apart, a null doc_id included.  Columns besides those used are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = None
    for number, shared in enumerate(_blocks(benchmark, window, block_pairs)):
        part = mapped(docs, _finder(shared, number == 0), _FOUND)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], x["e"]).alias("reach"),
        ),
    )["n"]
    return merged.select("doc_id", "n_words", covered.alias("n_hit"), "items").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The documents, all columns, in which no item window occurs; texts stay where they are."""

    def keeper(shared):
        def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            patterns = _patterns(shared)
            mask = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                parts = words(text)
                mask.append(not parts or next(patterns.search(b" " + b" ".join(parts) + b" "), None) is None)
            yield batch.filter(pa.array(mask, pa.bool_()))

        return keep

    for shared in _blocks(benchmark, window, block_pairs):
        documents = mapped(documents, keeper(shared), documents.schema)
    return documents
