"""Windows of a fixed number of units (bytes or words) that occur more than once in a corpus, found exactly.

Of each window the least hash among its grams is the anchor; consecutive windows with one anchor form a stretch.
Equal windows have equal anchors, so only stretches whose anchor occurs twice or more can hold a repeated window:
1. marks: (doc_id, first window, windows, anchor) of every stretch, about 1.3 % of the bytes or 6 % of the words;
2. anchors are counted (partial counts first), and stretches whose anchor stands alone are let go;
3. the rest are cut from the texts and packed as one string each; equal ones of a batch of documents, compared as
   bytes, are one string with a list of its places, which stays behind under the string's number;
4. the strings alone travel to their anchor's partition, where the windows of each anchor are sorted, and those that
   occur again, compared as bytes, are marked (`marked`, by operator); the marks go back to the places by number.
An anchor with over `batch` windows is split by the windows' own hash, so that no task holds more than about `batch`
windows of it: each part gets of each string what its windows take, and compares bytes like any other.
Documents that are copies of another are set aside by SHA-256 first: one of them stands for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, lean, sliding_min, split_by_ids, text_blocks

#: Windows that are sorted at a time.
BATCH_WINDOWS = 400_000
#: Bytes of text whose stretches are sought at a time; some hundred bytes are held for each.
MARK_BYTES = 1 << 18
#: Bytes of strings and places that a packing task holds at a time.
PACK_BYTES = 16 << 20
Marked = Callable[[list[bytes], np.ndarray, np.ndarray, "np.ndarray | None"], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """What a window is: its width in units, and how stretches are found, packed and compared."""

    width: int
    #: (bytes, offsets) -> per unit position its gram's hash; first unit of each document (one more at the end)
    grams: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    gram: int
    #: (bytes of one document) -> function of (first unit, one past the last) that gives the packed string
    packer: Callable[[bytes], Callable[[int, int], bytes]]
    #: (strings, windows of each, group of each, which windows count or None for all) -> flags of all windows, one string after the other
    marked: Marked
    #: (strings, windows of each) -> a 64-bit hash of every window
    hashes: Callable[[list[bytes], np.ndarray], np.ndarray]
    #: (string) -> function of (first window, one past the last) that gives the string of these windows alone
    part: Callable[[bytes], Callable[[int, int], bytes]]


MARKS = "doc_id long, at int, n int, anchor long"


def stretches(kind: Kind, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: document, first window (a unit of the document), number of windows and anchor of each stretch."""
    g, first = kind.grams(buf, offs)
    units, w = int(first[-1]), kind.width - kind.gram + 1
    none = np.zeros(0, np.int64)
    if units < kind.width:
        return none, none, none, none
    bits = np.uint64(max(1, units.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w)[: units - kind.width + 1]
    anchor = (key & low).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    valid = np.arange(len(anchor)) + kind.width <= first[doc + 1]
    turn = np.ones(len(anchor) + 1, bool)
    turn[1:-1] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(turn)
    at, n = edge[:-1], np.diff(edge)
    keep = valid[at]
    at, n = at[keep], n[keep]
    return doc[at], at - first[doc[at]], n, g[anchor[at]].astype(np.int64)


def marks_of(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, limit=MARK_BYTES):
            doc, at, n, anchor = stretches(kind, buf, offs)
            ids = rows.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor)], names=["doc_id", "at", "n", "anchor"])

    return run


PACKED = "id long, anchor long, n int, k int, packed binary, docs binary, places binary"


def packed_of(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of doc_id, text and lists at, n, anchor: the packed stretches, equal ones of a batch once with all their places."""

    def emit(found: dict, number: int) -> pa.RecordBatch:
        cols = [
            pa.array(np.arange(number, number + len(found))),
            pa.array([h for h, _ in found], pa.int64()),
            pa.array([x[2] for x in found.values()], pa.int32()),
            pa.array([len(x[0]) for x in found.values()], pa.int32()),
            pa.array([s for _, s in found], pa.binary()),
            pa.array([np.array(x[0], "<i8").tobytes() for x in found.values()], pa.binary()),
            pa.array([np.array(x[1], "<i4").tobytes() for x in found.values()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["id", "anchor", "n", "k", "packed", "docs", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        size, number = 0, TaskContext.get().partitionId() << 40
        for rows, _, _ in text_blocks(batches):
            for doc, text, at, n, anchor in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "at", "n", "anchor"))):
                cut = kind.packer(text.encode())
                for a, m, h in zip(at, n, anchor):
                    s = cut(a, a + m - 1 + kind.width)
                    x = found.setdefault((h, s), ([], [], m))
                    size += 16 if x[0] else len(s) + 200
                    x[0].append(doc)
                    x[1].append(a)
                    if size > PACK_BYTES:
                        yield emit(found, number)
                        number += len(found)
                        found, size = {}, 0
        if found:
            yield emit(found, number)

    return run


STRINGS = "id long, anchor long, bucket int, at int, n int, k int, packed binary, only binary"


def split_of(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of STRINGS from strings of anchors with `parts` parts: of each string what the windows of a part take, and which these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at_row in range(0, whole.num_rows, 2000):
                batch, out = whole.slice(at_row, 2000), []
                n = batch.column("n").to_numpy().astype(np.int64)
                strings = batch.column("packed").to_pylist()
                bucket = kind.hashes(strings, n) % np.repeat(batch.column("parts").to_numpy().astype(np.uint64), n)
                end = np.cumsum(n)
                for i, (name, anchor, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "k")))):
                    mine = bucket[end[i] - n[i] : end[i]]
                    cut = kind.part(strings[i])
                    for b in np.unique(mine).tolist():
                        w = np.flatnonzero(mine == b)
                        first, last = int(w[0]), int(w[-1])
                        out.append((name, anchor, b, first, last - first + 1, k, cut(first, last + 1), (w - first).astype("<i4").tobytes()))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in STRINGS.split(", ")])

    return run


def judged(kind: Kind, batch_windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of STRINGS sorted by anchor and bucket: (id, a, b) of the windows of a string that occur again."""

    def judge(groups: list[dict]) -> pa.RecordBatch:
        strings = [s for g in groups for s, _ in g]
        n = np.array([x[0] for g in groups for x in g.values()], np.int64)
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        owners = [x[1] for g in groups for x in g.values()]
        flags = np.repeat(np.array([x[2] > 1 for g in groups for x in g.values()]), n)
        offs = np.concatenate(([0], np.cumsum(n)))
        # a string alone in its group may still repeat within itself, if its anchor stands in it twice: it is judged like any other
        only = None
        if any(o for g in groups for _, o in g):
            only = np.ones(offs[-1], bool)
            for i, o in enumerate(o for g in groups for _, o in g):
                if o:
                    only[offs[i] : offs[i + 1]] = False
                    only[offs[i] + np.frombuffer(o, "<i4")] = True
        flags |= kind.marked(strings, n, group, only)
        # runs of flags, cut at the strings' bounds
        edge = flags.copy()
        edge[1:] &= ~flags[:-1]
        edge[offs[:-1]] = flags[offs[:-1]]
        stop = flags.copy()
        stop[:-1] &= ~flags[1:]
        stop[offs[1:] - 1] = flags[offs[1:] - 1]
        start, stop = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        string = np.searchsorted(offs, start, "right") - 1
        ids, a, b = [], [], []
        for i, x, y in zip(string.tolist(), (start - offs[string]).tolist(), (stop - offs[string]).tolist()):
            for name, at in owners[i]:
                ids.append(name)
                a.append(at + x)
                b.append(at + y)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []
        last, size = None, 0
        for batch in batches:
            for name, anchor, bucket, at, n, k, s, only in zip(*(batch.column(c).to_pylist() for c in ("id", "anchor", "bucket", "at", "n", "k", "packed", "only"))):
                if (anchor, bucket) != last:
                    if size > batch_windows // 4:  # so that with the next one, of `batch_windows` at most, it is little more
                        yield judge(groups)
                        groups, size = [], 0
                    groups.append({})
                    last = (anchor, bucket)
                x = groups[-1].setdefault((s, only), [n, [], 0])
                size += 2 if x[1] else n
                x[1].append((name, at))
                x[2] += k
        if groups:
            yield judge(groups)

    return run


def places_of(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, a, b) of the units that a string's windows a:b cover at each of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = [np.frombuffer(d, "<i8") for d in batch.column("docs").to_pylist()]
            at = [np.frombuffer(p, "<i4").astype(np.int64) for p in batch.column("places").to_pylist()]
            row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            a, b = (batch.column(c).to_numpy().astype(np.int64)[row] for c in ("a", "b"))
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(at + a), pa.array(at + b - 1 + kind.width)], names=["doc_id", "a", "b"])

    return run


def copies_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, rep): the documents whose text others have as well, each with the least doc_id of its text."""
    sums = scratch.cut(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")))
    many = scratch.cut(sums.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).filter("k > 1"))
    out = scratch.cut(hot_join(sums, many, ["sha"], "k", sums.count()).select("doc_id", "rep").distinct())
    scratch.drop(sums, many)
    return out


def repeated_ranges(docs: DataFrame, kind: Kind, scratch: Scratch, copies: DataFrame, batch: int = BATCH_WINDOWS) -> DataFrame:
    """(doc_id, a, b): unit ranges that repeated windows cover, of documents that aren't copies of a smaller doc_id. docs: doc_id, text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    later = copies.filter("doc_id != rep").select("doc_id").distinct()
    marks = scratch.cut(docs.mapInArrow(lean(marks_of(kind)), MARKS), texts=True)
    often = scratch.cut(marks.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"))
    some = scratch.cut(hot_join(marks, often, ["anchor"], "k", marks.count()).join(later, "doc_id", "left_anti").select("doc_id", "at", "n", "anchor"))
    scratch.drop(marks, often)
    # without the copies many an anchor stands alone
    counts = scratch.cut(some.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"))
    wanted = scratch.cut(hot_join(some, counts, ["anchor"], "k", some.count()).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "anchor")).alias("s")))
    scratch.drop(some, counts)

    rows = docs.join(wanted, "doc_id").select("doc_id", "text", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.col("s.anchor").alias("anchor"))
    packed = scratch.cut(rows.mapInArrow(lean(packed_of(kind)), PACKED), texts=True)
    scratch.drop(wanted)
    strings = packed.select("id", "anchor", "n", "k", "packed")
    heavy = scratch.cut(strings.groupBy("anchor").agg(F.sum("n").alias("w")).filter(F.col("w") > batch).select("anchor", F.ceil(F.col("w") / batch).cast("int").alias("parts")))
    light = strings.select("id", "anchor", F.lit(0).alias("bucket"), F.lit(0).alias("at"), "n", "k", "packed", F.lit(None).cast("binary").alias("only"))
    n_heavy = heavy.count()
    if n_heavy:
        heavy = F.broadcast(heavy) if n_heavy < 1 << 18 else heavy
        light = light.join(heavy.select("anchor"), "anchor", "left_anti").select(*light.columns)
        light = light.unionByName(strings.join(heavy, "anchor").select("id", "anchor", "n", "k", "packed", "parts").mapInArrow(lean(split_of(kind)), STRINGS))
    found = light.repartition(parts, "anchor", "bucket").sortWithinPartitions("anchor", "bucket").mapInArrow(lean(judged(kind, batch)), "id long, a int, b int")
    out = scratch.cut(packed.select("id", "docs", "places").join(found, "id").select("a", "b", "docs", "places").mapInArrow(lean(places_of(kind)), "doc_id long, a long, b long"))
    scratch.drop(packed)
    return out


def with_ranges(docs: DataFrame, kind: Kind, scratch: Scratch, batch: int = BATCH_WINDOWS) -> DataFrame:
    """docs (doc_id, text) with _a and _b, lists of the ranges to remove (unordered, they may overlap), and _copy: another document has the text."""
    copies = copies_of(docs, scratch)
    ranges = repeated_ranges(docs, kind, scratch, copies, batch).groupBy("doc_id").agg(F.collect_list("a").alias("_a"), F.collect_list("b").alias("_b"))
    # one row for each document that loses anything, so that only their texts are dealt, once
    loses = scratch.cut(ranges.join(copies.select("doc_id", F.lit(True).alias("_copy")), "doc_id", "full_outer").select("doc_id", "_a", "_b", F.coalesce("_copy", F.lit(False)).alias("_copy")))
    scratch.drop(copies)
    maybe, others = split_by_ids(docs, loses)
    none = [F.lit(None).cast("array<bigint>").alias("_a"), F.lit(None).cast("array<bigint>").alias("_b"), F.lit(False).alias("_copy")]
    return others.select("*", *none).unionByName(maybe.join(loses, "doc_id", "left").withColumn("_copy", F.coalesce("_copy", F.lit(False))))
