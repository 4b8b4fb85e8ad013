"""Word n-grams under interpolated modified Kneser-Ney, which grow with the trusted text.

Words are runs of bytes that are no white space, with the white space after them.
What no n-gram knows is spelled by the symbol model of `kneser_ney`.  There are
two models, each of one half of the trusted texts (by a hash of the text): a text
is scored by the model that has not seen it, so trusted texts and others compare.

An n-gram of order 3 is dealt to a bucket by its middle word, as three words of 48
bits in a packed run of its task's n-grams.  In a bucket meet the trusted n-grams
and those to be looked up, so n-grams, contexts, continuation counts and shares of
the orders 3 and 2 are found there and never written.  Words alone are counted by
an aggregate; the commonest go to every task, the others to the buckets that ask
for them by a join.  Lookups run in rounds, each over the middle words of one
residue, and a round's shuffle is given back when it ends, so what is on disk at a
time is a fraction of the n-grams.  A bucket returns a text's bits as one sum.

A bucket is read as a stream.  One of more than HELD n-grams, as those of the commonest
words, is dealt by hash of the n-gram to segments of a temporary file, and counted and
looked up some segments at a time: n-grams of a context or pair lie in many segments,
whose counts add up.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm import words as W
from deskline.llm.frames import BROADCAST_IDS, arrow_schema
from deskline.session import cut, freed, removed

_CODES = np.random.default_rng(5).integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight
_LONG = 64  # bytes of a word, beyond which all its bytes are hashed at once
_WORD = np.uint64(2**48 - 1)
_START = np.uint64(0x5851F42D4C957F2D) & _WORD  # before a text's first word
ROUNDS = 8
TRAIN_ROUNDS = 2  # of the trusted texts alone
BUCKET_BYTES = 2 << 20  # of text per bucket of a round, about 330,000 n-grams: most are held
TASK_GRAMS = 1 << 19  # n-grams that a task packs together, and
TASK_TEXTS = 1 << 16  # texts
SLICE_BYTES = (1 << 19) - 1  # of text worked on at a time
HELD = 1 << 19  # n-grams of a bucket in memory at a time, trusted ones and those looked up each
CHUNK = 1 << 17  # of them looked up at a time
SEGMENTS = 256  # of a bucket that is not held
_TRUSTED, _LOOKED_UP, _RARE = 0, 1, 2
_FOR_TRAINING, _FOR_BITS = 1, 2  # uses of a text
_PACKED = "bucket int, kind int, source long, n int, data binary"
_COUNTED = "order int, gram long, n long"
_SUMS = "_key long, _words double"


class Tables(NamedTuple):
    """own: discounted share of a seen n-gram; weight: what a context leaves to the shorter n-gram.

    Computed when asked for; `bits` finds the same numbers in its buckets.
    """

    own3: DataFrame
    weight3: DataFrame
    own2: DataFrame
    weight2: DataFrame
    own1: DataFrame
    weight1: DataFrame
    trusted: DataFrame  # fold, text
    words: DataFrame  # gram (word and model), n
    discounts: dict[int, list[float]]  # by order
    totals: dict[int, tuple[float, float]]  # by model: of all words' counts, and what their discounts leave


class _Grams(NamedTuple):
    """For each word w3 after w1 w2."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray  # where the next word of the text begins, or its end
    w1: np.ndarray
    w2: np.ndarray
    w3: np.ndarray


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


# ---- packed runs of n-grams ---------------------------------------------------


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal bytes; eight of them at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = end - start
    out = W.mix((eight[start] & _BYTES[np.minimum(left, 8)]) * _CODES[0] + left.astype(np.uint64))
    some = np.flatnonzero(left > 8)
    for k in range(8, _LONG, 8):
        out[some] = W.mix(out[some] + (eight[start[some] + k] & _BYTES[np.minimum(left[some] - k, 8)]) * _CODES[0])
        some = some[left[some] > k + 8]
    if len(some):
        out[some] = W.Spans(data).hash(start[some], end[some])
    return out


def _grams(column: pa.Array) -> _Grams:
    data, offsets = W.bytes_of(column)
    starts, start, end = W.bounds(data, offsets, W.NOT_SPACE)
    owner = np.repeat(np.arange(len(column)), np.diff(starts))
    place = np.arange(len(owner)) - starts[owner]
    before = [_word_hashes(data, start, end) & _WORD]
    for k in (1, 2):
        some = np.full(len(owner), _START, np.uint64)
        some[k:] = before[0][:-k]
        some[place < k] = _START
        before.append(some)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stop = np.where(last, offsets[owner + 1], np.append(start[1:], 0)[: len(owner)])
    return _Grams(owner, start, stop, before[2], before[1], before[0])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte, so that those which are mostly 0 take no place when compressed."""
    each = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((width, len(values)), np.uint8)
    for i in range(width):
        out[i] = each[:, i]
    return out.tobytes()


def _values(data: memoryview, n: int, width: int) -> tuple[np.ndarray, memoryview]:
    out = np.zeros((n, 8), np.uint8)
    for i in range(width):
        out[:, i] = np.frombuffer(data[i * n : (i + 1) * n], np.uint8)
    return out.view("<u8").reshape(n), data[n * width :]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.diff(np.append(first, len(values)))


def _packed(buckets: int, source: int, kind: int, columns: dict[str, np.ndarray], texts: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """A row per bucket.  texts: of what `text` counts, key, model and use."""
    order = np.argsort(_bucket(columns["w2"], buckets).astype(np.uint64) << np.uint64(48) | columns["w2"])
    for k in columns:  # one at a time, so that few are held twice
        columns[k] = columns[k][order]
    which, sizes = _runs(_bucket(columns["w2"], buckets))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for b, lo, hi in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = {k: v[lo:hi] for k, v in columns.items()}
        w2, times = _runs(some.pop("w2"))
        out = [np.array([len(w2)], "<u8").tobytes(), _planes(w2, 6), _planes(times, 4)]
        if kind == _LOOKED_UP:
            there, some["text"] = np.unique(some["text"], return_inverse=True)
            out += [np.array([len(there)], "<u8").tobytes(), *[_planes(t[there], w) for t, w in zip(texts, (8, 1, 1), strict=True)]]
        out += [_planes(v, _WIDTH[k]) for k, v in some.items()]
        yield b, kind, source, hi - lo, b"".join(out)


_WIDTH = {"w1": 6, "w3": 6, "n": 4, "model": 1, "gram": 7, "text": 4, "spelled": 8}
_COLUMNS = {_TRUSTED: ("w1", "w3", "n", "model"), _LOOKED_UP: ("w1", "w3", "n", "text", "spelled"), _RARE: ("gram", "n")}


def _unpacked(kind: int, n: int, data: bytes) -> dict[str, np.ndarray]:
    def number() -> int:
        nonlocal rest
        found, rest = int(np.frombuffer(rest[:8], "<u8")[0]), rest[8:]
        return found

    def values(size: int, width: int) -> np.ndarray:
        nonlocal rest
        found, rest = _values(rest, size, width)
        return found

    rest, out = memoryview(data), {}
    some = number()
    w2 = values(some, 6)
    out["w2"] = np.repeat(w2, values(some, 4).astype(np.int64))
    if kind == _LOOKED_UP:
        there = number()
        out["keys"] = values(there, 8)
        models, uses = values(there, 1), values(there, 1)
    out |= {k: values(n, _WIDTH[k]) for k in _COLUMNS[kind]}
    if kind == _LOOKED_UP:
        out |= {"model": models[out["text"].astype(np.int64)], "use": uses[out["text"].astype(np.int64)]}
    return out


def _round(w2: np.ndarray, rounds: int) -> np.ndarray:
    return w2 % np.uint64(rounds)


def _bucket(w2: np.ndarray, buckets: int) -> np.ndarray:
    return ((w2 >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _dealt(texts: DataFrame, kind: int, buckets: int, of: tuple[int, int] = (0, 1), spelling=None, steps: int = 1, symbol_grams=None) -> DataFrame:
    """Packed n-grams of `fold, text` (and `_key, use` of those looked up) whose middle word is in round `of[0]` of `of[1]`."""
    schema = arrow_schema(_PACKED)

    def found(part: pa.RecordBatch, table: np.ndarray | None) -> dict[str, np.ndarray]:
        column, model = part.column("text"), part.column("fold").to_numpy(zero_copy_only=False)
        at = _grams(column)
        if of[1] > 1:
            at = _Grams(*[x[some] for some in [np.flatnonzero(_round(at.w2, of[1]) == of[0])] for x in at])
        tri = W.mix(W.mix(at.w2 * _CODES[0] + at.w3) * _CODES[1] + at.w1)
        if kind == _TRUSTED:  # counts for the model of the other half
            m = (1 - model[at.owner]).astype(np.uint64)
            _, some, n = np.unique(tri ^ m, return_index=True, return_counts=True)
            return {"w2": at.w2[some], "w1": at.w1[some], "w3": at.w3[some], "n": n.astype(np.uint32), "model": m[some].astype(np.uint8)}
        own = W.mix(tri + at.owner.astype(np.uint64) * _CODES[2])  # an n-gram of a text
        _, some, which, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        sizes = at.stop - at.start
        edges = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(edges[-1]) + np.repeat(at.start - edges[:-1], sizes)
        total = np.concatenate([[0], np.cumsum(table[symbol_grams(column, place)[1]], dtype=np.int64)])
        spelled = np.zeros(len(n), np.int64)
        np.add.at(spelled, which, total[edges[1:]] - total[edges[:-1]])
        return {"w2": at.w2[some], "w1": at.w1[some], "w3": at.w3[some], "n": n.astype(np.uint32), "text": at.owner[some].astype(np.uint32), "spelled": spelled}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.frombuffer(spelling.value, np.uint16) if spelling else None
        source = TaskContext.get().partitionId() << 24

        def rows() -> Iterator[tuple]:
            nonlocal source
            held: list[dict[str, np.ndarray]] = []
            texts: list[pa.RecordBatch] = []
            grams = count = 0

            def packed() -> Iterator[tuple]:
                if not grams:
                    return
                columns = {k: np.concatenate([h.pop(k) for h in held]) for k in [*held[0]]}
                about = ()
                if kind == _LOOKED_UP:
                    about = tuple(np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in texts]).astype(np.int64).view(np.uint64) for c in ("_key", "fold", "use"))
                yield from _packed(buckets, source, kind, columns, about)

            for batch in batches:
                for part in W.slices(batch, "text", SLICE_BYTES):
                    if grams >= TASK_GRAMS or count + part.num_rows > TASK_TEXTS:
                        yield from packed()
                        held, texts, grams, count, source = [], [], 0, 0, source + 1
                    more = found(part, table)
                    if "text" in more:
                        more["text"] = more["text"] + np.uint32(count)
                        texts.append(part.drop_columns(["text"]))
                    held.append(more)
                    grams += len(more["w2"])
                    count += part.num_rows
            yield from packed()

        yield from _batches(rows(), schema)
        _released()

    return texts.mapInArrow(run, _PACKED)


# ---- counts of a bucket -------------------------------------------------------


def _hashes(model: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, ...]:
    """tri, ctx, bi, mid, gram"""
    model = model.astype(np.uint64)
    mid = W.mix(w2 * np.uint64(2) + model)
    ctx, bi = W.mix(mid + w1 * _CODES[0]), W.mix(mid + w3 * _CODES[1])
    return W.mix(bi + w1 * _CODES[2]), ctx, bi, mid, w3 * np.uint64(2) + model


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _released() -> None:
    """A worker is kept for the next task; what this one freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class _Runs:
    """N-grams of a bucket; if they are more than `most`, all lie in a file, by segments of their hash."""

    def __init__(self, kinds: dict[str, str], most: int):
        self.kinds, self.most = kinds, most
        self.parts: list[dict[str, np.ndarray]] = []
        self.held = 0
        self.sizes = np.zeros(SEGMENTS, np.int64)
        self.places: list[list[tuple[int, int, int]]] = [[] for _ in range(SEGMENTS)]
        self.file = None

    def add(self, columns: dict[str, np.ndarray]) -> None:
        self.parts.append({k: columns[k].astype(kind, copy=False) for k, kind in self.kinds.items()})
        self.held += len(columns["w2"])
        if self.held > self.most:
            self.spill()

    def joined(self) -> dict[str, np.ndarray]:
        return {k: np.concatenate([p.pop(k) for p in self.parts]) if self.parts else np.zeros(0, kind) for k, kind in self.kinds.items()}

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
        columns = self.joined()
        self.parts, self.held = [], 0
        segment = (_hashes(columns["model"], columns["w1"], columns["w2"], columns["w3"])[0] % np.uint64(SEGMENTS)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        columns = {k: v[order] for k, v in columns.items()}
        sizes = np.bincount(segment, minlength=SEGMENTS)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for i in np.flatnonzero(sizes).tolist():
            data = b"".join(v[edges[i] : edges[i + 1]].view(np.uint8).reshape(-1, v.itemsize).T.tobytes() for v in columns.values())
            packed = pa.compress(data, "lz4", asbytes=True)
            self.places[i].append((self.file.tell(), len(packed), int(sizes[i])))
            self.file.write(packed)
        self.sizes += sizes

    def read(self, lo: int, hi: int) -> dict[str, np.ndarray]:
        if not self.file:
            return self.joined()
        parts = []
        width = sum(np.dtype(kind).itemsize for kind in self.kinds.values())
        for at, size, n in (x for i in range(lo, hi) for x in self.places[i]):
            self.file.seek(at)
            rest, part = memoryview(pa.decompress(self.file.read(size), n * width, "lz4")), {}
            for k, kind in self.kinds.items():
                bytes_ = np.dtype(kind).itemsize
                part[k] = np.frombuffer(rest[: n * bytes_], np.uint8).reshape(bytes_, n).T.copy().view(kind).reshape(n)
                rest = rest[n * bytes_ :]
            parts.append(part)
        return {k: np.concatenate([p.pop(k) for p in parts]) if parts else np.zeros(0, kind) for k, kind in self.kinds.items()}


class _Sums:
    """Values by key, added up; `first` is the same for all rows of a key."""

    def __init__(self, most: int):
        self.most = most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.merged = 0

    def add(self, key: np.ndarray, first: np.ndarray, *sums: np.ndarray) -> None:
        """Keys come sorted, each once."""
        self.parts.append((key, first, *sums))
        self.rows += len(key)
        if len(self.parts) > 1 and self.rows > 2 * self.merged + self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        """key, first, sums"""
        if len(self.parts) > 1:
            key, first, *sums = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            key, some, which = np.unique(key, return_index=True, return_inverse=True)
            self.parts = [(key, first[some], *[np.bincount(which, x, len(key)).astype(x.dtype) for x in sums])]
        self.rows = self.merged = len(self.parts[0][0])
        return self.parts[0]


_SEEN = {"w1": "u8", "w2": "u8", "w3": "u8", "n": "u4", "model": "u1"}
_ASKED = _SEEN | {"key": "u8", "source": "i8", "spelled": "i8"}


class _Bucket:
    """trusted: n-grams with the model that they count for; asked: to be looked up; rare: `w2, gram, n`."""

    def __init__(self, batches: Iterator[pa.RecordBatch], most: int):
        self.most = most
        self.trusted, self.asked = _Runs(_SEEN, most), _Runs(_ASKED, most)
        rare: list[dict[str, np.ndarray]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "source", "n", "data")), strict=True):
                self._add(rare, *row)
        self.rare = {k: np.concatenate([r[k] for r in rare]) if rare else np.zeros(0, np.uint64) for k in ("w2", "gram", "n")}
        self.ranges = [(0, SEGMENTS)]
        if self.trusted.file or self.asked.file:
            for r in (self.trusted, self.asked):
                r.spill()
            self.ranges, size = [], 0
            for i, n in enumerate((self.trusted.sizes + self.asked.sizes).tolist()):
                if self.ranges and size + n <= most:
                    self.ranges[-1], size = (self.ranges[-1][0], i + 1), size + n
                else:
                    self.ranges, size = [*self.ranges, (i, i + 1)], n

    def _add(self, rare: list[dict[str, np.ndarray]], kind: int, source: int, n: int, data: bytes) -> None:
        r = _unpacked(kind, n, data)
        if kind == _RARE:
            rare.append(r)
            return
        if kind == _TRUSTED:
            self.trusted.add(r)
            return
        grams = ("w1", "w2", "w3", "n")
        training = np.flatnonzero(r["use"] & np.uint64(_FOR_TRAINING))
        if len(training):
            self.trusted.add({k: r[k][training] for k in grams} | {"model": np.uint64(1) - r["model"][training]})
        bits = np.flatnonzero(r["use"] & np.uint64(_FOR_BITS))
        if len(bits):
            some = {k: r[k][bits] for k in (*grams, "model", "spelled")}
            self.asked.add(some | {"key": r["keys"][r["text"][bits].astype(np.int64)], "source": np.full(len(bits), source, np.int64)})

    def seen(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """tri, n3 (how often), ctx, bi, mid, gram of the different trusted n-grams in these segments."""
        t = self.trusted.read(lo, hi)
        if not self.trusted.file:  # it is read once more
            self.trusted.parts = [{**t}]
        tri, *others = _hashes(t["model"], t["w1"], t["w2"], t["w3"])
        tri, some, which = np.unique(tri, return_index=True, return_inverse=True)
        return tri, np.bincount(which, t["n"], len(tri)).astype(np.int64), *[x[some] for x in others]

    def counts(self, d: list[float] | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """(ctx, its mid, counts, what they leave), (bi, its gram, its mid, different words before it), n-grams there 1, 2, 3, 4 times."""
        ctx, bi, times = _Sums(self.most), _Sums(self.most), np.zeros(4, np.int64)
        for lo, hi in self.ranges:
            _, n3, c, b, mid, gram = self.seen(lo, hi)
            times += np.bincount(np.minimum(n3, 5), minlength=6)[1:5]
            c, some, at = np.unique(c, return_index=True, return_inverse=True)
            left = np.bincount(at, _discount(n3, d), len(c)) if d else np.zeros(len(c))
            ctx.add(c, mid[some], np.bincount(at, n3, len(c)), left)
            b, some, n2 = np.unique(b, return_index=True, return_counts=True)
            bi.add(b, np.stack([gram[some], mid[some]], 1), n2)
        b, first, n2 = bi.merge()
        return ctx.merge(), (b, first[:, 0], first[:, 1], n2), times

    def pairs(self, bi: tuple[np.ndarray, ...], d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own by bi; mid, weight by mid)"""
        _, _, mid, n2 = bi
        mid, at = np.unique(mid, return_inverse=True)
        return *_shares(n2, at, len(mid), d), mid


def _discount(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _shares(n: np.ndarray, at: np.ndarray, contexts: int, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(own by n-gram, weight by context)"""
    total, left = np.bincount(at, n, contexts), np.bincount(at, _discount(n, d), contexts)
    return (n - _discount(n, d)) / total[at], left / np.maximum(total, 1)


def _discounts(n: dict[int, int]) -> list[float]:
    n = {i: n.get(i) or 0 for i in range(1, 5)}
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.1) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]


def _buckets(texts: DataFrame, rounds: int = 1) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(1, round(size / rounds / BUCKET_BYTES)), 65_535)  # sorted by 16 bits of bucket


def train(trusted: DataFrame) -> Tables:
    trusted = trusted.select(fold(F.col("text")).alias("fold"), "text")
    buckets = _buckets(trusted)
    counted, most = arrow_schema(_COUNTED), HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of order 1: a word's pairs; of the others: how many n-grams are there so often."""
        _, (_, gram, _, n2), times = _Bucket(batches, most).counts()
        gram, n1 = np.unique(gram, return_counts=True)
        orders, grams, n = [np.full(len(gram), 1, np.int32)], [gram.view(np.int64)], [n1]
        for order, some in ((2, np.bincount(np.minimum(n2, 5), minlength=6)[1:5]), (3, times)):
            orders.append(np.full(4, order, np.int32))
            grams.append(np.arange(1, 5))
            n.append(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) for x, kind in ((orders, np.int32), (grams, np.int64), (n, np.int64))], schema=counted)
        _released()

    by = lambda found: found.groupBy("order", "gram").agg(F.sum("n").alias("n"))
    with freed(trusted.sparkSession):
        rounds = [_dealt(trusted, _TRUSTED, -(-buckets // TRAIN_ROUNDS), (k, TRAIN_ROUNDS)).groupBy("bucket") for k in range(TRAIN_ROUNDS)]
        parts = [cut(by(dealt.applyInArrow(count, _COUNTED)), "word-counts") for dealt in rounds]
        found = cut(by(functools.reduce(DataFrame.union, parts)), "word-counts")
        removed(*parts)
    dealt = _dealt(trusted, _TRUSTED, buckets).groupBy("bucket")
    often = {k: {r["gram"]: r["n"] for r in found.where(F.col("order") == k).collect()} for k in (2, 3)}  # four rows each
    words = found.where(F.col("order") == 1).select("gram", F.pmod("gram", F.lit(2)).cast("int").alias("model"), "n")
    d = {k: _discounts(n) for k, n in often.items()}
    d[1] = _discounts({i: n or 0 for i, n in enumerate(words.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first(), start=1)})
    discount = F.element_at(F.array(*map(F.lit, d[1])), F.least("n", F.lit(3)).cast("int"))
    by_model = words.groupBy("model").agg(F.sum("n").alias("total"), F.sum(discount).alias("left"))
    totals = {r["model"]: (float(r["total"]), r["left"]) for r in by_model.collect()}  # two rows
    total = functools.reduce(lambda x, m: x.when(F.col("model") == m, F.lit(totals[m][0])), totals, F.when(F.lit(False), 0.0))

    def shares(name: str, of: Callable[[_Bucket], Iterator[np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in of(_Bucket(batches, most)):
                yield pa.RecordBatch.from_arrays([pa.array(found)], [name])

        return dealt.applyInArrow(run, f"{name} double")

    def own3(bucket: _Bucket) -> Iterator[np.ndarray]:
        ctx, _, total, _ = bucket.counts(d[3])[0]
        for lo, hi in bucket.ranges:
            _, n3, c, *_ = bucket.seen(lo, hi)
            yield (n3 - _discount(n3, d[3])) / total[np.searchsorted(ctx, c)]

    def weight3(bucket: _Bucket) -> Iterator[np.ndarray]:
        _, _, total, left = bucket.counts(d[3])[0]
        yield left / np.maximum(total, 1)

    return Tables(
        shares("own3", own3),
        shares("weight3", weight3),
        shares("own2", lambda bucket: [bucket.pairs(bucket.counts()[1], d[2])[0]]),
        shares("weight2", lambda bucket: [bucket.pairs(bucket.counts()[1], d[2])[1]]),
        words.select("gram", ((F.col("n") - discount) / total).alias("own1")),
        by_model.select("model", (F.col("left") / F.col("total")).alias("weight1")),
        trusted,
        words.select("gram", "n"),
        d,
        totals,
    )


# ---- lookups --------------------------------------------------------------------


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are there, their places)"""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _taken(values: np.ndarray, found: tuple[np.ndarray, np.ndarray], other: float) -> np.ndarray:
    there, at = found
    out = np.full(len(there), other)
    out[there] = values[at[there]]
    return out


def _common(words: DataFrame) -> tuple[bytes, bytes, DataFrame | None]:
    """The commonest words, BROADCAST_IDS at most, sorted, with their counts; the others."""
    limits = [0, *[1 << k for k in range(50)]]
    above = words.agg(*[F.count_if(F.col("n") > x) for x in limits]).first()
    limit = next(x for x, n in zip(limits, above, strict=True) if n <= BROADCAST_IDS)
    most = words.where(F.col("n") > limit).toArrow()
    gram, n = most.column("gram").to_numpy().astype(np.uint64), most.column("n").to_numpy().astype(np.uint32)
    order = np.argsort(gram)
    return gram[order].tobytes(), n[order].tobytes(), words.where(F.col("n") <= limit) if limit else None


def _rare(texts: DataFrame, common, words: DataFrame) -> DataFrame:
    """`w2, gram, n`: words that are not common and known, by the words before them in the texts."""
    schema = arrow_schema("gram long, w2 long")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(common.value[0], np.uint64)
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                at = _grams(part.column("text"))
                gram = at.w3 * np.uint64(2) + part.column("fold").to_numpy(zero_copy_only=False).astype(np.uint64)[at.owner]
                gram, which = np.unique(gram, return_inverse=True)
                some = np.flatnonzero(~_found(known, gram)[0][which])
                gram, w2 = gram[which[some]], at.w2[some]
                _, some = np.unique(W.mix(gram) ^ w2, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (gram, w2)], schema=schema)
        _released()

    asked = texts.mapInArrow(ask, "gram long, w2 long")
    with freed(texts.sparkSession):
        return cut(asked.join(words, "gram").groupBy("w2", "gram").agg(F.first("n").alias("n")), "rare-words")


def _rare_dealt(rare: DataFrame, buckets: int, of: tuple[int, int]) -> DataFrame:
    schema = arrow_schema(_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _batches(_packed(buckets, 0, _RARE, {c: batch.column(c).to_numpy().view(np.uint64) for c in ("w2", "gram", "n")}, ()), schema)

    return rare.where(F.col("w2") % of[1] == of[0]).mapInArrow(run, _PACKED)


def bits(documents: DataFrame, tables: Tables, spelling: np.ndarray, steps: int, symbol_grams) -> DataFrame:
    """`_key, _words`: bits of the words of each text by xxhash64 of it; texts without words are not there.

    Where the documents say which are `_trusted`, those are all that the tables are of; else these are dealt beside them.
    """
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(spelling.tobytes())
    *most, others = _common(tables.words)
    common = context.broadcast(tuple(most))
    d, totals = tables.discounts, tables.totals
    texts = documents.select(F.xxhash64("text").alias("_key"), fold(F.col("text")).alias("fold"), "text")
    rare = _rare(texts, common, others) if others is not None else None
    buckets = _buckets(texts, ROUNDS)
    if "_trusted" in documents.columns:
        use = F.when(F.col("_trusted"), _FOR_TRAINING | _FOR_BITS).otherwise(_FOR_BITS)
        dealt_texts = documents.select(F.xxhash64("text").alias("_key"), fold(F.col("text")).alias("fold"), "text", use.alias("use"))
    else:
        beside = tables.trusted.select(F.lit(0).cast("long").alias("_key"), "fold", "text", F.lit(_FOR_TRAINING).alias("use"))
        dealt_texts = texts.withColumn("use", F.lit(_FOR_BITS)).union(beside)

    total1 = np.array([totals.get(m, (1.0, 1.0))[0] for m in (0, 1)])
    weight1 = np.array([x[1] / x[0] if (x := totals.get(m)) else 1.0 for m in (0, 1)])
    summed, most = arrow_schema("source long, data binary"), HELD

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(batches, most)
        (ctx, _, total3, left3), pairs, _ = bucket.counts(d[3])
        own2, weight2, mids = bucket.pairs(pairs, d[2])
        known, often = np.frombuffer(common.value[0], np.uint64), np.frombuffer(common.value[1], np.uint32)
        pair = W.mix(bucket.rare["gram"]) ^ bucket.rare["w2"]
        order = np.argsort(pair)
        pair, times1 = pair[order], bucket.rare["n"][order]

        def bits_of(tri: np.ndarray, n3: np.ndarray, r: dict[str, np.ndarray]) -> np.ndarray:
            model = r["model"].astype(np.int64)
            t, c, b, mid, gram = _hashes(r["model"], r["w1"], r["w2"], r["w3"])
            word, which = np.unique(gram, return_inverse=True)
            n1 = _taken(often, _found(known, word), 0)[which]
            if len(pair):
                n1 = np.maximum(n1, _taken(times1, _found(pair, W.mix(gram) ^ r["w2"]), 0))
            own1 = (n1 - _discount(n1.astype(np.int64), d[1])) / total1[model]
            there, at = context = _found(ctx, c)
            total = _taken(total3, context, 1.0)
            at3 = _taken(left3, context, 1.0) / total
            n = _taken(n3, _found(tri, t), 0)
            own3 = (n - _discount(n.astype(np.int64), d[3])) / total
            at2 = _taken(weight2, _found(mids, mid), 1.0)
            seen = own3 + at3 * (_taken(own2, _found(pairs[0], b), 0.0) + at2 * own1)
            left = at3 * at2 * weight1[model]  # for the spelling
            times = r["n"].astype(np.float64)
            spelled = r["spelled"].astype(np.float64) / times / steps
            some = seen > 0
            each = spelled - np.log2(left)
            each[some] = -np.log2(seen[some] + left[some] * np.exp2(-spelled[some]))
            return times * each

        for lo, hi in bucket.ranges:
            tri, n3, *_ = bucket.seen(lo, hi)
            r = bucket.asked.read(lo, hi)
            each = [bits_of(tri, n3, {k: v[i : i + CHUNK] for k, v in r.items()}) for i in range(0, len(r["n"]), CHUNK)]
            if not each:
                continue
            _, some, which = np.unique(W.mix(r["key"]) + r["source"].view(np.uint64), return_index=True, return_inverse=True)  # a source's text
            sums, key, source = np.bincount(which, np.concatenate(each), len(some)), r["key"][some], r["source"][some]
            order = np.argsort(source, kind="stable")
            sources, sizes = _runs(source[order])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            key, sums = key[order], sums[order]
            data = [key[a:z].tobytes() + sums[a:z].tobytes() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.int64()), pa.array(data, pa.binary())], schema=summed)
        _released()

    def add(table: pa.Table) -> pa.Table:
        both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("data").to_pylist()]
        key, which = np.unique(np.concatenate([b[0] for b in both]), return_inverse=True)
        total = np.bincount(which, np.concatenate([b[1] for b in both]).view(np.float64), len(key))
        return pa.table({"_key": key.view(np.int64), "_words": total.astype(np.float64)})

    parts = []
    with freed(documents.sparkSession):
        for k in range(ROUNDS):
            of = (k, ROUNDS)
            dealt = _dealt(dealt_texts, _LOOKED_UP, buckets, of, shared, steps, symbol_grams)
            if rare is not None:
                dealt = dealt.union(_rare_dealt(rare, buckets, of))
            looked_up = dealt.groupBy("bucket").applyInArrow(look, "source long, data binary")
            sums = looked_up.groupBy("source").applyInArrow(add, _SUMS)
            parts.append(cut(sums.groupBy("_key").agg(F.sum("_words").alias("_words")), "word-bits"))
        sums = functools.reduce(DataFrame.union, parts).groupBy("_key").agg(F.sum("_words").alias("_words"))
        copies = texts.groupBy("_key").agg(F.count("*").alias("copies"))
        return cut(sums.join(copies, "_key").select("_key", (F.col("_words") / F.col("copies")).alias("_words")), "word-bits")
