"""Words and word windows of whole Arrow batches, as 64-bit hashes.

All work is on the UTF-8 bytes of a batch at once.  Separators and case folding
concern ASCII only, so a table of 256 entries decides both; bytes of other
characters never equal an ASCII byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21  # text worked on at a time; one longer text is one slice

_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _IDENTITY.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

# True for bytes of words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # letters, digits and everything beyond ASCII
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
ALNUM[0x80:] = True

_random = np.random.default_rng(20240229)
_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


class Words(NamedTuple):
    """`first[i]:first[i + 1]` are the words of text i; `start`, `end` are byte offsets."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `limit` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + limit, side="right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in them); null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, min(1 << (n - 1).bit_length(), SLICE_BYTES + 2))
        inverse = pow(_BASE, -1, 2**64)
        out = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        if size > SLICE_BYTES + 2:  # for one very long text; not kept
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


class Spans:
    """Hashes of any byte ranges of one batch, equal for equal (folded) bytes."""

    def __init__(self, data: np.ndarray, fold: np.ndarray = _IDENTITY):
        self.power, self.inverse = _up_to(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[fold][data] * self.power[: len(data)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])


def sums(hashes: np.ndarray):
    """A function of (start, end): hashes of ranges of the given sequence, equal for equal ranges."""
    power, inverse = _up_to(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return lambda start, end: mix((total[end] - total[start]) * inverse[start])


def bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, starts, ends) of the maximal runs of word bytes within texts."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(start, offsets), start, end


def words_of(column: pa.Array, is_word: np.ndarray = NOT_SPACE, fold: np.ndarray = _IDENTITY) -> Words:
    data, offsets = bytes_of(column)
    first, start, end = bounds(data, offsets, is_word)
    return Words(first, start, end, Spans(data, fold).hash(start, end))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of n words; a text of fewer words, but not none, is one run.

    Runs come text by text, in order; the hash also tells the number of words.
    """
    count = np.diff(words.first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), runs)
    place = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = words.first[:-1][text] + place
    length = np.minimum(count, n)[text]
    total = length.astype(np.uint64) * _PLACES[n]
    for k in range(n):
        if length.size and length.min() > k:
            total += words.hash[at + k] * _PLACES[k]
        else:
            there = np.flatnonzero(length > k)
            total[there] += words.hash[at[there] + k] * _PLACES[k]
    return text, mix(total)


def lists(values: pa.Array | np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """Values cut at `edges` as a list column."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
