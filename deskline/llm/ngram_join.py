"""Documents with nearly the same word shingles, by a grouped prefix join.

1. Every shingle is counted: tasks deal short hashes into buckets as packed
   bytes, and a bucket sorts and counts its own.  Shingles in more than
   `common_from` documents are marked in a bit table of fixed size.  The marks
   only choose an order (common ones last), so a wrong mark costs time, never a link.
2. A document's prefix is its first |x| - ceil(t |x|) + 1 shingles in that order;
   two similar sets share a prefix shingle.  Documents of equal size and prefix
   are one group; only groups are compared.
3. Rare prefix shingles occur at most `common_from` times, so all pairs of their
   groups are listed, filtered by size and by position.  Where a common shingle
   is in a prefix, each group is paired with the one that has it earliest.
4. Group pairs are expanded to their different sets, and sets are compared whole.
   First every set is compared with the partner it shares most prefix shingles
   with; pairs that are then connected need no comparison.  All pairs still in
   two components are compared after that, the common shingles' included, except
   where the parity sketches of both sets prove that too many shingles differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm import words as W
from deskline.llm.frames import arrow_schema, mapped, matched
from deskline.llm.graph import components
from deskline.session import cut

SHINGLE = 5
PERCENT = 75
COMMON_FROM = 8
MARK_BITS = 26  # the bit table has 2**26 bits, 8 MB
BUCKET_BYTES = 16_000_000  # of text whose shingles one bucket counts
SKETCH_WORDS = 16  # 64-bit words of a parity sketch


# ---- sets of shingles -----------------------------------------------------


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the distinct shingles of each text, ascending."""
    found = W.words_of(column, W.NOT_SPACE, W.LOWER)
    text, shingle = W.windows(found, size)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    return np.searchsorted(text, np.arange(len(column) + 1)), shingle


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[edges[1:]] - total[edges[:-1]]


def _at_least(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent n / 100)"""
    return -(-n * percent // 100)


# ---- common shingles --------------------------------------------------------


def _mark_places(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _common_marks(documents: DataFrame, size: int, common_from: int) -> np.ndarray:
    """Bit table of shingles in more than `common_from` documents (or, if these are too many for it, in more often ones)."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # A bucket is a range of the hash's low bits; 4 more bytes tell its shingles apart.
        _, shingle = _sets(batch.column("text"), size)
        low = shingle & np.uint64(0xFFFFFFFF)
        bucket = ((low * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        high = (shingle >> np.uint64(32)).astype("<u4")[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        data = [high[edges[b] : edges[b + 1]].tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(data, pa.binary())], ["bucket", "hashes"])

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batch, "text"):
            yield from deal(part)

    schema = "level int, word int, bits long, n long"
    arrow = arrow_schema(schema)

    def count(table: pa.Table) -> pa.Table:
        hashes = np.sort(np.frombuffer(b"".join(table.column("hashes").to_pylist()), "<u4"))
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        times = np.diff(np.append(starts, len(hashes)))
        often = times > common_from
        place = (hashes[starts][often] >> np.uint32(32 - MARK_BITS)).astype(np.int64)
        level = np.floor(np.log2(times[often])).astype(np.int64)
        keys, where = np.unique(level << 40 | place >> 6, return_inverse=True)
        bits = np.zeros(len(keys), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (place & 63).astype(np.uint64))
        columns = [keys >> 40, keys & ((1 << 40) - 1), bits.view(np.int64), np.bincount(where, minlength=len(keys))]
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    dealt = mapped(documents.select("text"), sliced, "bucket long, hashes binary")
    common = cut(dealt.groupBy("bucket").applyInArrow(count, schema), "common")
    levels = {r["level"]: r["n"] for r in common.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    from_level, held = 64, 0
    for level in sorted(levels, reverse=True):  # the most frequent ones first, while the table stays sparse
        held += levels[level]
        if held > 1 << (MARK_BITS - 3) and from_level < 64:
            break
        from_level = level
    table = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    marks = common.where(F.col("level") >= from_level).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    table[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    return table


# ---- prefixes ---------------------------------------------------------------

_SIGNED = "doc_id long, n long, k1 long, k2 long, gid long, rare int, prefix array<long>, sketch array<long>"


def _sketches(shingle: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row SKETCH_WORDS words in which bit b tells whether the row has an odd number of shingles that hash to b."""
    bit = (shingle & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64)
    words = np.zeros(rows * SKETCH_WORDS, np.uint64)
    np.bitwise_xor.at(words, row * SKETCH_WORDS + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return words


def _signatures(documents: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """Per document: set size, 128-bit key of the set, group, and the prefix where the task has not had the group yet.

    With a prefix that has common shingles comes the parity sketch of the whole set.
    """
    schema = arrow_schema(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield sign(part, marks, seen)

    def sign(batch: pa.RecordBatch, marks: np.ndarray, seen: set[int]) -> pa.RecordBatch:
        edges, shingle = _sets(batch.column("text"), size)
        n = np.diff(edges)
        place = _mark_places(shingle)
        common = (marks[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        text = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((shingle, common, text))
        k1, k2 = _sums(W.mix(shingle), edges), _sums(W.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), edges)
        length = np.where(n > 0, n - _at_least(n, percent) + 1, 0)
        taken = order[np.arange(len(order)) - edges[:-1][text] < length[text]]  # `text` is unchanged by the order within texts
        first = np.concatenate([[0], np.cumsum(length)])
        rare = length - _sums(common[taken], first).astype(np.int64)
        gid = W.mix(_sums(W.mix(shingle[taken]), first) + n.astype(np.uint64)).view(np.int64)
        new = []
        for g, has_id in zip(gid.tolist(), batch.column("doc_id").is_valid().to_pylist()):
            new.append(has_id and g not in seen)  # a row without id takes no part
            if has_id:
                seen.add(g)
        new = np.array(new, bool) & (n > 0)
        keep = np.repeat(new, length)
        edge = np.concatenate([[0], np.cumsum(np.where(new, length, 0))])
        drawn = new & (rare < length)
        number = np.cumsum(drawn) - 1
        of_drawn = drawn[text]
        sketch = _sketches(shingle[of_drawn], number[text[of_drawn]], int(drawn.sum()))
        columns = [
            batch.column("doc_id"),
            pa.array(n.astype(np.int64)),
            pa.array(k1.view(np.int64)),
            pa.array(k2.view(np.int64)),
            pa.array(gid),
            pa.array(rare.astype(np.int32)),
            W.lists(shingle[taken][keep].view(np.int64), edge),
            W.lists(sketch.view(np.int64), np.concatenate([[0], np.cumsum(drawn) * SKETCH_WORDS])),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return documents.mapInArrow(run, _SIGNED)


# ---- candidates ---------------------------------------------------------------


def _similar_sizes(n1, n2, p1, p2, percent: int):
    """Whether sets of sizes n1, n2 that first meet at places p1, p2 of their orders can be similar (Columns or arrays)."""
    rest1, rest2 = n1 - p1, n2 - p2
    need = percent * (n1 + n2)  # the overlap o must satisfy (100 + percent) o >= need
    return (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1) & ((100 + percent) * rest1 >= need) & ((100 + percent) * rest2 >= need)


def _may_overlap(n1, n2, sketch1, sketch2, percent: int):
    """Whether sets of these sizes and parity sketches can be similar; also where a sketch is null.

    Shingles in both sets cancel out: each bit that differs takes at least one shingle that only one of them has.
    """
    differ = sum((F.bit_count(sketch1[i].bitwiseXOR(sketch2[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return F.coalesce((100 + percent) * (n1 + n2 - differ) >= 2 * percent * (n1 + n2), F.lit(True))


def _rare_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """`a, b, hits`: groups that share a rare prefix shingle; `postings` are sorted by shingle within partitions.

    A shingle's rows are a short run (it is in few documents); every two of its groups are looked at.
    """
    schema = arrow_schema("a long, b long, hits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if carry is None else pa.concat_batches([carry, batch])
            key = whole.column("shingle").to_numpy()
            stop = int(np.searchsorted(key, key[-1]))
            carry = whole.slice(stop)
            yield pair(whole.slice(0, stop))
        if carry is not None:
            yield pair(carry)

    def pair(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, gid, n, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("shingle", "gid", "n", "pos"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (gid[1:] != gid[:-1])  # a group signed by several tasks
        key, gid, n, pos = key[new], gid[new], n[new], pos[new]
        left, right = [], []
        for lag in range(1, len(key)):
            i = np.flatnonzero(key[:-lag] == key[lag:])
            if not len(i):
                break
            i = i[_similar_sizes(n[i], n[i + lag], pos[i], pos[i + lag], percent)]
            left.append(gid[i])
            right.append(gid[i + lag])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
        both, hits = np.unique(both, axis=0, return_counts=True) if len(a) else (both, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(hits.astype(np.int64))], schema=schema)

    return postings.mapInArrow(run, "a long, b long, hits long")


def _common_stars(postings: DataFrame, percent: int) -> DataFrame:
    """Each group with those in which a common shingle comes first: the most typical sets around it.

    There is one for each range of sizes; sets that can be similar are in the same range or the next.
    """
    ranged = postings.withColumn("range", F.floor(F.log("n") / math.log(100 / percent)).cast("int"))
    head = ranged.groupBy("shingle", "range").agg(F.min(F.struct("pos", "n", "gid")).alias("head"))
    near = ranged.withColumn("range", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)))
    joined = near.join(head, ["shingle", "range"]).where(F.col("gid") != F.col("head.gid"))
    joined = joined.where(_similar_sizes(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos"), percent))
    a, b = F.least("gid", "head.gid").alias("a"), F.greatest("gid", "head.gid").alias("b")
    return joined.groupBy(a, b).agg(F.count("*").alias("hits"))


def _common_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of groups with a common prefix shingle that are not in one component.

    One of such two groups is outside the component that most groups of the shingle are in, so only
    those are joined with all groups of the shingle.  `postings` have `low, high`: the components of the group's sets,
    and `sketch`: that of the group's set, null if there are several.
    """
    most = postings.groupBy("shingle", "low").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "low")).alias("most"))
    outside = postings.join(most, "shingle").where((F.col("low") != F.col("most.low")) | (F.col("high") != F.col("low"))).drop("most")
    other = postings.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("gid", "n", "pos", "low", "high", "sketch")])
    apart = (F.col("low") != F.col("low2")) | (F.col("high") != F.col("high2")) | (F.col("low") != F.col("high"))
    fits = _similar_sizes(F.col("n"), F.col("n2"), F.col("pos"), F.col("pos2"), percent)
    fits = fits & _may_overlap(F.col("n"), F.col("n2"), F.col("sketch"), F.col("sketch2"), percent)
    joined = outside.join(other, "shingle").where((F.col("gid") != F.col("gid2")) & apart & fits)
    return joined.select(F.least("gid", "gid2").alias("a"), F.greatest("gid", "gid2").alias("b")).distinct()


# ---- verification -------------------------------------------------------------


def _verified(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs `a, b` of documents those whose whole sets are similar enough."""
    pairs = cut(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batch, "text"):
            edges, shingle = _sets(part.column("text"), size)
            blobs = [shingle[edges[i] : edges[i + 1]].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "hashes"])

    sets = mapped(matched(documents, wanted, "doc_id", "left_semi"), hashed, "doc_id long, hashes binary")

    def compared(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for left, right in zip(batch.column("h1"), batch.column("h2")):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("h1")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("h2")), "b")
    return mapped(two, compared, "a long, b long").distinct()


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with `component`: the smallest node connected to it, itself without links."""
    found = components(links).select(F.col("node").alias("rep"), "component")
    return nodes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def similar_documents(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, common_from: int = COMMON_FROM) -> DataFrame:
    """`doc_id, n_shingles, component_id, class_id` per document.

    Two documents link when 100 |x & y| >= percent |x | y| for their sets of
    distinct word shingles (A-Z lower-cased; a text of fewer words is one
    shingle).  component_id is the smallest doc_id reachable by links; class_id
    the smallest with the same set.  A text without words (null, empty, white
    space) has no shingles and links with nothing.  Repeated rows of a doc_id
    with the same text give one row each.  A row without doc_id comes out without
    ids and takes no part in links.  If rows of one doc_id differ in text, each
    row is returned and the id has the links of all its texts.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(_common_marks(docs, size, common_from).tobytes())
    signed = cut(_signatures(docs, shared, size, percent), "signed")

    sets = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # A class of equal sets is named by its smallest document; classes of one group have the same gid.
    classes = cut(sets.groupBy("gid", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    groups = classes.groupBy("gid").agg(F.min("rep").alias("first"), F.count("*").alias("members"))

    postings = sets.select("gid", "n", "rare", F.posexplode("prefix").alias("pos", "shingle"))
    rare = postings.where(F.col("pos") < F.col("rare")).select("shingle", "gid", F.col("n").cast("int"), "pos")
    rare = rare.repartition("shingle").sortWithinPartitions("shingle", "gid")
    common = cut(postings.where(F.col("pos") >= F.col("rare")).select("shingle", "gid", "n", "pos").distinct(), "postings")
    found = _rare_pairs(rare, percent)
    found = cut(found.groupBy("a", "b").agg(F.sum("hits").alias("hits")), "found")

    # First each set with its best partner, and the sets of a group with the group's first.
    stars = found.unionByName(_common_stars(common, percent)).groupBy("a", "b").agg(F.sum("hits").alias("hits"))
    ends = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "hits"))
    best = ends.groupBy("a").agg(F.max(F.struct("hits", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    names = groups.select("gid", "first")
    between = best.join(names.withColumnsRenamed({"gid": "a", "first": "x"}), "a").join(names.withColumnsRenamed({"gid": "b", "first": "y"}), "b")
    within = classes.join(groups.where("members > 1"), "gid").where(F.col("rep") != F.col("first")).select(F.col("rep").alias("x"), F.col("first").alias("y"))
    tried = cut(_ordered(between).unionByName(_ordered(within)).distinct(), "tried")
    links = cut(_verified(tried, known, size, percent), "links")

    # Then all pairs of sets that are still apart.
    labelled = cut(_labels(classes, links), "labelled")
    spread = labelled.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    ends1 = spread.select(F.col("gid").alias("a"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    ends2 = spread.select(F.col("gid").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = (F.col("low1") != F.col("low2")) | (F.col("high1") != F.col("high2")) | (F.col("low1") != F.col("high1"))
    open_pairs = found.select("a", "b").join(ends1, "a").join(ends2, "b").where(apart).select("a", "b")
    drawn = sets.where(F.size("sketch") > 0).groupBy("gid").agg(F.min("sketch").alias("sketch"))
    known_by = spread.join(drawn, "gid").withColumn("sketch", F.when(F.col("members") == 1, F.col("sketch"))).drop("members")
    open_pairs = open_pairs.unionByName(_common_pairs(common.join(known_by, "gid"), percent))
    inside = spread.where(F.col("low") != F.col("high")).select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    side1 = labelled.select(F.col("gid").alias("a"), F.col("rep").alias("x"), F.col("component").alias("c1"))
    side2 = labelled.select(F.col("gid").alias("b"), F.col("rep").alias("y"), F.col("component").alias("c2"))
    pairs = open_pairs.unionByName(inside).distinct().join(side1, "a").join(side2, "b").where(F.col("c1") != F.col("c2"))
    pairs = _ordered(pairs.select("x", "y")).distinct().join(tried, ["a", "b"], "left_anti")
    more = cut(_verified(pairs, known, size, percent), "links")

    labels = labelled.select(F.col("component").alias("rep")).distinct()
    merged = more.join(labelled.select(F.col("rep").alias("a"), F.col("component").alias("c1")), "a")
    merged = merged.join(labelled.select(F.col("rep").alias("b"), F.col("component").alias("c2")), "b")
    final = _labels(labels, merged.select(F.col("c1").alias("a"), F.col("c2").alias("b"))).withColumnRenamed("rep", "first")
    named = labelled.withColumnRenamed("component", "first").join(final, "first").select("gid", "k1", "k2", "rep", "component")
    with_words = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return signed.join(named, ["gid", "k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.when(with_words, F.col("component")), "doc_id").alias("component_id"),
        F.coalesce(F.when(with_words, F.col("rep")), "doc_id").alias("class_id"),
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def first_of_each_group(documents: DataFrame, **settings) -> DataFrame:
    """The documents, all columns, that are the smallest of their component."""
    found = similar_documents(documents, **settings).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return matched(documents, found, "doc_id", "left_anti")
