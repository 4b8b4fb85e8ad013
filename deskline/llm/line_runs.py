"""Repeated lines, by levelled sorted runs of line hashes.

A run is a table of `h1, h2, docs, last`: each line key (128 bits of hash), in
how many documents of its batches it occurs and the largest id among them,
sorted by hash.  Every batch of documents adds one run to level 0; `fan_out`
runs of a level are merged into one run of the next, so a key is rewritten only
once per level.  Batches hold whole documents, so counts of runs add up.

Which holder of a line is the last one, and whether enough documents hold it, is
only known when all batches have been added.  So documents are gone through
twice: the first sweep adds the batches, the second merges each batch's line
occurrences with the runs and anti-joins those that go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.frames import mapped
from deskline.session import cut

MIN_CHARS = 20  # shorter keys are never dropped
MIN_DOCUMENTS = 3
BATCHES = 4
FAN_OUT = 2
_SPACE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(2**63)  # a null doc_id: one document, smaller than all others


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def occurrences(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`h1, h2, doc, text_key, pos` of every line whose key is long enough."""
    lines = documents.select(
        _id().alias("doc"),
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    keys = lines.where(F.length("line") >= min_chars).select("doc", "text_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_key", "pos"
    )


class LineRuns:
    """The levels of runs; each run is a written table in the shared folder."""

    def __init__(self, fan_out: int = FAN_OUT):
        self.fan_out = max(2, fan_out)
        self.levels: list[list[DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        """Adds the occurrences of some whole documents, in no earlier batch, as a run."""
        held = batch.select("h1", "h2", "doc").distinct()
        self._put(0, held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("last")))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(cut(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) == self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(full))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        return both.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def dropped(self, batch: DataFrame, min_documents: int) -> DataFrame:
        """The occurrences of lines that enough documents hold, but in the last holder."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return batch.where(F.lit(False))
        frequent = self._merged(runs).where(F.col("docs") >= min_documents).drop("docs")
        return batch.join(frequent, ["h1", "h2"]).where(F.col("doc") != F.col("last")).drop("last")


def without_repeated_lines(
    documents: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """The documents, all columns, with `text` cut and `n_lines, n_dropped` added.

    Lines end at newlines; a null or empty text is one empty line and comes out
    empty.  Lines with the same key of at least `min_chars` code points, held by
    at least `min_documents` documents, go everywhere except in the document
    with the largest id that holds one (there all copies stay).  Rows with the
    same doc_id are one document; documents without an id are one with the
    smallest id.  Each row is returned.  Columns named as the added ones are replaced.
    """
    held = cut(occurrences(documents, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(fan_out)
    for number in range(batches):
        runs.add(held.where(F.col("batch") == number))
    gone = runs.dropped(held, min_documents)
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("_gone"))
    kept = documents.drop("n_lines", "n_dropped")
    # The row travels as one value, so no name in it can clash.
    own = kept.select(F.struct(*kept.columns).alias("row"), _id().alias("doc"), F.xxhash64("text").alias("text_key"))
    own = own.join(gone, ["doc", "text_key"], "left")
    text = F.coalesce("row.text", F.lit("")).alias("text")
    own = own.select("_gone", *[text if c == "text" else F.col("row")[c].alias(c) for c in kept.columns])
    out = kept.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return mapped(own, _cut_lines, out)


def _cut_lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts, counts, drops = [], [], []
    for text, gone in zip(batch.column("text").to_pylist(), batch.column(0).to_pylist()):
        lines = text.split("\n")
        if gone:
            places = set(gone)
            text = "\n".join(line for i, line in enumerate(lines) if i not in places)
        texts.append(text)
        counts.append(len(lines))
        drops.append(len(gone) if gone else 0)
    names = batch.schema.names[1:]
    columns = [pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, batch.columns[1:])]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], [*names, "n_lines", "n_dropped"])
