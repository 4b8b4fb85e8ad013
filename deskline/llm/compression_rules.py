"""Quality rules on word statistics and zstandard compression bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm import words as W
from deskline.llm.frames import mapped

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3
# (bytes below, least ratio, greatest ratio) of compressed to plain size.  Frame overhead makes short texts vary more.
WHOLE_BANDS = [(128, 0.0, np.inf), (256, 0.20, np.inf), (512, 0.30, 0.95), (1024, 0.30, 0.85), (65536, 0.30, 0.72), (np.inf, 0.25, 0.72)]
CHUNK = 4096  # bytes; a last chunk of less than half is left out
CHUNK_BAND = (0.25, 0.75)
MAX_BAD_CHUNKS = 1 / 3  # of a document's chunks

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_SPACE = " \t\n\x0b\x0c\r"


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeated(words: W.Words) -> np.ndarray:
    """Per text, the words inside 3-word windows that occur more than once in it."""
    text, run = W.windows(words, 3)
    count = np.diff(words.first)
    place = np.arange(len(text)) - np.searchsorted(text, text)
    order = np.lexsort((run, text))
    same = (text[order][1:] == text[order][:-1]) & (run[order][1:] == run[order][:-1])
    often = np.zeros(len(text), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = words.first[:-1][text[often]] + place[often]
    covered = np.zeros(len(words.hash), bool)
    for k in range(3):
        covered[at + k] = True
    return _sums(covered, words.first) * (count >= 3)


def _duplicate_lines(text: str | None) -> int:
    seen: set[str] = set()
    again = 0
    for line in (text or "").split("\n"):
        if line in seen:
            again += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return again


def _ratio(compressor: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(compressor.compress(data)) / len(data)


def _bands(compressor: zstandard.ZstdCompressor, data: bytes) -> tuple[float | None, float, bool]:
    """(ratio of the whole text, share of chunks out of their band, whether both rules pass)"""
    if not data:
        return None, 0.0, True
    whole = _ratio(compressor, data)
    low, high = next((low, high) for below, low, high in WHOLE_BANDS if len(data) < below)
    # A last chunk of less than half the size goes with the one before, so that all of the text is judged.
    edges = [*range(0, max(len(data) - CHUNK // 2 + 1, 1), CHUNK), len(data)]
    chunks = [data[i:j] for i, j in zip(edges, edges[1:])]
    ratios = [_ratio(compressor, c) for c in chunks if len(c) * 2 >= CHUNK]  # a text of one short chunk has its whole ratio only
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in ratios) / len(ratios) if ratios else 0.0
    return whole, bad, low <= whole <= high and bad <= MAX_BAD_CHUNKS


_OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks double"
)


def judged(documents: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Word statistics and the verdict per document.

    Words are runs without ASCII white space.  base_failed: fewer than
    `min_words` words, or more than `max_repeat_percent` % of them in 3-word windows
    that occur again in the text.  kept: not base_failed, and neither the whole
    text's compression ratio nor more than a third of its chunks' lie outside
    their bands (too low: repetitive; too high: incompressible).  A last chunk of under
    half the size counts with the one before it.  `ratio` is null
    for a text without bytes.  A null text has no words.  Every row gives one row.
    """

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for part in W.slices(batch, "text"):
            data, offsets = W.bytes_of(part.column("text"))
            words = W.words_of(part.column("text"))
            n = np.diff(words.first)
            inside = W.NOT_SPACE[data] & _STARTS_CHARACTER[data]
            repeat = _repeated(words)
            lines = [_duplicate_lines(t) for t in part.column("text").to_pylist()]
            raw = data.tobytes()
            bands = [_bands(compressor, raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
            kept = ~failed & np.array([b[2] for b in bands], bool)
            columns = [part.column("doc_id"), n, _sums(inside, offsets), _sums(_SYMBOL[data], offsets), lines, repeat, failed, kept]
            columns += [pa.array([b[0] for b in bands], pa.float64()), [b[1] for b in bands]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = [f.split()[0] for f in _OUT.split(", ")]
    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judge, _OUT)
