"""Suffix-array dedup: every byte that a 200-byte string covers which also starts elsewhere in the corpus goes.

Texts are bytes of UTF-8. Candidate stretches of window starts come by anchors (see windows.py); within the
stretches of one anchor the suffixes are sorted. Comparing two suffixes takes a logarithmic number of steps: their
common extension is found by binary search over prefix polynomial hashes, and the 8 bytes after it decide. The sort
merges stably, pass by pass: each run of suffixes that agree so far is extended by the common extension of all its
members, then ordered by the next 8 bytes, until runs are single or agree in the full width; what comes out is the
group's suffix array, up to that width. Suffixes next to each other in it whose hashes agree in full are compared
byte by byte (8 at a time) before they count, so that colliding hashes mark nothing that is not equal.

Defined cases: null and empty texts are 0 bytes, nothing removed. Texts under 200 bytes lose nothing, copies or
not. doc_id is a key; repeated rows are copies of each other and give a row each. Overlapping strings count, within a document as well; judged on the input, so that all
occurrences go, the first too. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cover, lean, mix, prefix_hash, span_hash, table, text_blocks
from .windows import BATCH_WINDOWS, Kind, with_ranges

WIDTH, GRAM = 200, 48


def byte_grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(buf) < GRAM:
        return np.zeros(0, np.uint64), offs
    at = np.arange(len(buf) - GRAM + 1)
    return mix(span_hash(prefix_hash(buf), at, at + GRAM)), offs


def lcp(c: np.ndarray, x: np.ndarray, y: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Length of the common extension of suffixes x and y, known to be `least` at least; binary search over prefix hashes."""
    low, high = least.copy(), np.full(len(x), most)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = span_hash(c, x, x + mid) == span_hash(c, y, y + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def sorted_suffixes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of the suffixes `at` in order of group and then of their first `width` bytes, equal ones as they came;
    and flags of those that, by their hashes, agree in all of these bytes with the one before."""
    c = prefix_hash(buf)
    eight = np.ndarray(len(buf) + 1, ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    order = np.argsort(group, kind="stable")
    equal = np.zeros(len(order), bool)
    # places of the order whose runs of suffixes still have to be told apart, the run of each and what it has in common
    place = np.arange(len(order))
    run, depth = group[order], np.zeros(len(order), np.int64)
    while len(place):
        turn = np.concatenate(([True], run[1:] != run[:-1]))
        start = np.flatnonzero(turn)
        size = np.diff(np.concatenate((start, [len(place)])))
        keep = np.repeat(size > 1, size)
        if not keep.all():
            place, run, depth = place[keep], run[keep], depth[keep]
            if not len(place):
                break
            start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            size = np.diff(np.concatenate((start, [len(place)])))
        mine = order[place]
        pivot = np.repeat(at[mine[start]], size)
        common = np.repeat(np.minimum.reduceat(lcp(c, at[mine], pivot, depth, width), start), size)
        full = common >= width
        if full.any():
            equal[place[full]] = True
            equal[place[start[full[start]]]] = False
            place, run, common, mine = place[~full], run[~full], common[~full], mine[~full]
            if not len(place):
                break
        # bytes beyond the width don't count
        block = eight[at[mine] + common].astype(np.uint64) >> (np.uint64(8) * (8 - np.minimum(width - common, 8)).astype(np.uint64))
        again = np.lexsort((block, run))  # stable merges, by run and then by block
        order[place] = mine[again]
        block, run, common = block[again], run[again], common[again]
        turn = np.concatenate(([False], (run[1:] != run[:-1]) | (block[1:] != block[:-1])))
        run, depth = np.cumsum(turn), np.minimum(common + 8, width)
    return order, equal


def equal_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    same = np.ones(len(x), bool)
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 and width > 8 else [])]:
        same &= eight[x + k] == eight[y + k]
    return same


def window_starts(n: np.ndarray, width: int) -> np.ndarray:
    """Where each window of the strings, one after the other, begins."""
    begin = np.concatenate(([0], np.cumsum(n + width - 1)[:-1])).astype(np.int64)
    string = np.repeat(np.arange(len(n)), n)
    return begin[string] + np.arange(len(string)) - (np.cumsum(n) - n)[string]


def marked_bytes(strings: list[bytes], n: np.ndarray, group: np.ndarray, only: np.ndarray | None = None, width: int = WIDTH) -> np.ndarray:
    """Flags of the windows (those of `only` alone, if given) that occur again in a string of the same group, or again in their own."""
    buf = np.frombuffer(b"".join(strings), np.uint8)
    at, group = window_starts(n, width), np.repeat(group, n)
    flags = np.zeros(len(at), bool)
    which = np.arange(len(at)) if only is None else np.flatnonzero(only)
    order, equal = sorted_suffixes(buf, at[which], group[which], width)
    pair = np.flatnonzero(equal)
    x, y = which[order[pair - 1]], which[order[pair]]
    same = equal_bytes(buf, at[x], at[y], width)
    flags[x[same]] = flags[y[same]] = True
    return flags


def byte_hashes(strings: list[bytes], n: np.ndarray, width: int = WIDTH) -> np.ndarray:
    at = window_starts(n, width)
    return mix(span_hash(prefix_hash(np.frombuffer(b"".join(strings), np.uint8)), at, at + width))


BYTES = Kind(WIDTH, byte_grams, GRAM, lambda text: lambda a, b: text[a:b], marked_bytes, byte_hashes, lambda s: lambda a, b: s[a : b - 1 + WIDTH])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(copy: bool, n: int, a: list[int] | None, b: list[int] | None, width: int) -> np.ndarray:
    """Flags of a document's units that go."""
    if copy and n >= width:
        return np.ones(n, bool)
    return cover(n, np.array(a, np.int64), np.array(b, np.int64)) if a else np.zeros(n, bool)


def cut_bytes(with_text: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_blocks(batches):
            out = []
            for doc, text, a, b, copy in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "_a", "_b", "_copy"))):
                data = (text or "").encode()
                gone = removed(copy, len(data), a, b, WIDTH)
                spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_bytes(docs: DataFrame, scratch: Scratch, with_text: bool = False, batch: int = BATCH_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left; null unless `with_text`)."""
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    out = with_ranges(plain, BYTES, scratch, batch).mapInArrow(lean(cut_bytes(with_text)), OUT)
    return out if with_text else scratch.cut(out, texts=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "op8")).drop("kept")
