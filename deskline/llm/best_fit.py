"""Packing token sequences: bounded-space online best-fit.

Documents are tokenised where they lie and cut into pieces of at most
`capacity` tokens.  A packer keeps a fixed number of open bins; a bitset has one
bit per amount of free space that some open bin has, so the tightest bin that
still takes a piece is the lowest set bit from the piece's length up.  A full bin
closes; when all bins are open and none fits, the fullest closes first.

Every partition packs its own pieces.  What its open bins hold at the end goes
on to a next round with fewer partitions, whose inputs are again bounded (bins
of `MERGE` packers), until one is left; so only a few bins stay unfilled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.frames import arrow_schema, mapped
from deskline.llm.words import LOWER, Spans, bounds, bytes_of, slices
from deskline.session import cut

CAPACITY = 4096
END = 1  # the id that ends a document
OPEN_BINS = 64
MERGE = 16  # packers whose open bins one packer of the next round takes
CACHE_WORDS = 1_500_000  # words whose ids a task remembers, about 40 bytes each
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_NO_BREAK = np.ones(256, bool)  # bytes of words
_NO_BREAK[[0x0A, 0x20]] = False
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long, is_open boolean"


class _Ids:
    """Ids of words by the hash of their lower-case bytes, as sorted arrays that grow with the words seen.

    Words are split at ASCII space and newline, which no token crosses, and the
    tokenizer does not tell cases apart.  Beyond CACHE_WORDS the table starts anew.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.marks = {ord(m): np.array(tokenizer.encode(m, add_special_tokens=False).ids, "<u4") for m in ".,"}
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)  # where a word's ids begin in `ids`, and how many there are
        self.counts = np.zeros(0, np.int64)
        self.ids = np.concatenate([self.marks[m] for m in sorted(self.marks)])

    def mark(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, counts) of the ids of marks, which come first in `ids`."""
        sizes = [len(self.marks[m]) for m in sorted(self.marks)]
        which = np.searchsorted(sorted(self.marks), byte)
        return np.array([0, sizes[0]])[which], np.array(sizes)[which]

    def places(self, hashes: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        """(starts, counts) of the ids of sorted distinct hashes; text(i) is the word of the i-th."""
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            found, counts = self._encoded([text(i) for i in new.tolist()])
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, found])
            where = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, where, hashes[new])
            self.starts = np.insert(self.starts, where, starts)
            self.counts = np.insert(self.counts, where, counts)
            at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.counts[at]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, how many each has).

        Letters alone are one unit to the tokenizer: many such words are encoded as one text and told apart afterwards.
        """
        ids: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        letters = [i for i, w in enumerate(words) if _LETTERS.fullmatch(w)]
        for i in range(0, len(letters), 2000):
            some = letters[i : i + 2000]
            found = self.tokenizer.encode(" ".join([words[k] for k in some]), add_special_tokens=False)
            units, data = np.array(found.word_ids), np.array(found.ids, "<u4")
            if len(units) == 0 or units[-1] + 1 != len(some):
                raise ValueError("this tokenizer does not take letters as one unit")
            edges = np.searchsorted(units, np.arange(len(some) + 1)).tolist()
            for k, start, stop in zip(some, edges, edges[1:]):
                ids[k] = data[start:stop]
        rest = [i for i, w in enumerate(words) if not _LETTERS.fullmatch(w)]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            ids[k] = np.array(found.ids, "<u4")
        return np.concatenate(ids), np.array([len(x) for x in ids])


_tokenizers: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = _Ids(Tokenizer.from_file(path))
    return _tokenizers[path]


def token_ids(texts: pa.Array, ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of all texts, where each text's begin and end), without the ends of documents."""
    data, offsets = bytes_of(texts)
    first, start, end = bounds(data, offsets, _NO_BREAK)
    # A mark after an ASCII letter, at a word's end, is a unit of its own.
    last = data[end - 1]
    marked = np.flatnonzero((end - start > 1) & ((last == ord(".")) | (last == ord(","))) & _IS_LETTER[data[end - 2]])
    end[marked] -= 1
    hashes, some, which = np.unique(Spans(data, LOWER).hash(start, end), return_index=True, return_inverse=True)
    low, high = start[some].tolist(), end[some].tolist()
    raw = data.tobytes()
    places, counts = ids.places(hashes, lambda i: raw[low[i] : high[i]].decode())
    # Words and marks in order: a place in the table of ids and a number of ids each.
    has_mark = np.zeros(len(start), np.int64)
    has_mark[marked] = 1
    unit = np.arange(len(start)) + np.cumsum(has_mark) - has_mark
    unit_place, unit_count = np.empty((2, len(start) + len(marked)), np.int64)
    unit_place[unit], unit_count[unit] = places[which], counts[which]
    unit_place[unit[marked] + 1], unit_count[unit[marked] + 1] = ids.mark(last[marked])
    upto = np.concatenate([[0], np.cumsum(unit_count)])
    out = ids.ids[np.arange(upto[-1]) + np.repeat(unit_place - upto[:-1], unit_count)]
    return out, upto[np.append(unit, len(unit_count))[first]]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; `tokenizer` is the path of its file on all machines."""
    schema = arrow_schema(_PIECES)

    def cut_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        rows: list[tuple] = []
        for some in slices(batch, "text"):
            found, edges = token_ids(some.column("text"), ids)
            raw, edges = found.tobytes(), (edges * 4).tolist()
            for doc, begin, stop in zip(some.column("doc_id").to_pylist(), edges, edges[1:]):
                all_ids = raw[begin:stop] + end
                for number, start in enumerate(range(0, len(all_ids), capacity * 4)):
                    part = all_ids[start : start + capacity * 4]
                    rows.append((doc, number, start // 4, len(part) // 4, zlib.crc32(part)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut_up, _PIECES)


class Packer:
    """Open bins by free space; `full` gets each closed bin."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f tokens free
        self.by_free: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
            del self.by_free[free]
        self.count -= 1
        return out

    def add(self, row: int, length: int) -> list | None:
        """Places a piece; returns the rows of a bin that closes by it."""
        if length == self.capacity:
            return [row]
        fits = self.bits >> length
        closed = None
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            if self.count == self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            free, held = self.capacity, []
        held.append(row)
        if free == length:
            return held
        self._put(free - length, held)
        return closed

    def _put(self, free: int, held: list) -> None:
        self.by_free.setdefault(free, []).append(held)
        self.bits |= 1 << free
        self.count += 1

    def rest(self) -> Iterator[list]:
        for bins in self.by_free.values():
            yield from bins


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, round_: int, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    partition = TaskContext.get().partitionId()
    packer = Packer(capacity, open_bins)
    names = schema.names[:5]  # of _PIECES
    base = (round_ << 56) | (partition << 32)
    number = 0
    held: dict[int, tuple] = {}  # the rows in open bins
    count = 0

    def placed(rows: list[int], is_open: bool) -> list[tuple]:
        nonlocal number
        out, offset = [], 0
        for r in rows:
            row = held.pop(r)
            out.append((*row, base | number, offset, is_open))
            offset += row[3]
        number += 1
        return out

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    for batch in batches:
        done: list[tuple] = []
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            held[count] = row
            closed = packer.add(count, row[3])
            count += 1
            if closed is not None:
                done += placed(closed, False)
        yield table(done)
    yield table([row for rows in packer.rest() for row in placed(rows, True)])


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces with `sequence_id, offset`; a sequence holds at most `capacity` tokens, without gaps.

    A table without rows gives none.  The rounds end with one packer; the last
    one's open bins are sequences as they are.
    """
    order = ["doc_id", "piece", "start", "ids_crc32", "length"]
    packer = F.shiftright("sequence_id", 32).bitwiseAND(F.lit(0xFFFFFF))
    schema = arrow_schema(_PLACED)
    done, rest, round_ = None, found, 0
    while True:
        step = cut(rest.mapInArrow(lambda b, r=round_: _packed(b, schema, r, capacity, open_bins), _PLACED), "packed")
        width = (step.where("is_open").agg(F.max(packer)).first()[0] or 0) + 1
        part = (step if width == 1 else step.where(~F.col("is_open"))).drop("is_open")
        done = part if done is None else done.unionByName(part)
        if width == 1:
            return done
        round_ += 1
        rest = step.where("is_open").drop("sequence_id", "offset", "is_open")
        rest = rest.coalesce(-(-width // MERGE)).sortWithinPartitions(F.xxhash64("doc_id", "piece"), *order)


def packed_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    The tokenizer must drop white space, fold cases and take a run of letters as one unit.
    Of two bins that fit a piece equally tightly the one filled last takes it.
    Only documents of more than `capacity` tokens (the end included) are cut.  A
    null or empty text is the end alone.  Repeated rows are packed once each; a
    null doc_id stays null.  Other columns are ignored.
    """
    return pack(cut(pieces(documents, tokenizer, capacity), "pieces"), capacity, open_bins)
