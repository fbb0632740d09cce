"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over the token windows of every text.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A benchmark item gives its
windows of `n` consecutive words; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit; candidates found by hash count only after their words compare equal as bytes.

The set is arrays: the items' text, the places of its words, and by length the sorted hashes of windows with their
places, some four bytes for each byte of text. It is made once, on the driver, and broadcast in blocks of at most
`block` bytes of benchmark text, each scanned over every document, so that its size is bounded however large the
benchmark grows; what is found over all blocks decides, whatever their number. One block, the usual case, needs no
shuffle at all.

Defined cases: null and empty texts have no words, no hits and no items; texts of any length are taken whole. Null or
empty items have no windows, and items without an id are left out. Items with equal windows all count. Repeated
item_ids count once. Repeated rows give a row each, as do rows of one doc_id with different texts; a null doc_id is an
id like others. Extra columns are returned by `remove_contaminated` as they came.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, cover, equal_spans, gram_hashes, padded, table, text_blocks, word_hashes, words

N, MIN_ITEMS, BLOCK = 8, 2, 32 << 20
#: Pairs of a document's window and an item's that are compared at a time.
PAIRS = 1 << 18


class Windows:
    """The windows of some items: by length their sorted hashes and the items' words that they begin with."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        raw = [(text or "").encode() for _, text in items]
        buf = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        start, end, first = words(buf, np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), ALNUM)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.buf, self.start, self.size, self.first = padded(buf), start.astype(np.int32), (end - start).astype(np.int32), first
        h, per = word_hashes(buf, start, end), np.diff(first)
        item = np.repeat(np.arange(len(per)), per)
        left = first[item + 1] - np.arange(len(item)) if len(item) else np.zeros(0, np.int64)
        self.by_length = []
        for k in range(1, n + 1):  # an item of k < n words is one window
            at = np.flatnonzero(left >= n) if k == n else first[:-1][per == k]
            if len(at):
                g = gram_hashes(h, k)[at]
                order = np.argsort(g, kind="stable")
                self.by_length.append((k, g[order], at[order].astype(np.int32)))

    def equal(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """Whether the k words from x of a text are those from y of the items."""
        same = np.ones(len(x), bool)
        for t in range(k):
            same &= size[x + t] == self.size[y + t]
            which = np.flatnonzero(same)
            a, b = x[which] + t, y[which] + t
            same[which] = equal_spans(buf, start[a], self.buf, self.start[b], size[a])
        return same


def scan(buf: np.ndarray, offs: np.ndarray, wanted: Windows) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Of a block of documents: the first word of each, flags of the words hit, and the ids of the documents' items."""
    low = LOWER[buf]
    start, end, first = words(low, offs, ALNUM)
    h, low, size = word_hashes(low, start, end), padded(low), end - start
    hit_at, hit_to, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for k, hashes, places in wanted.by_length:
        g = gram_hashes(h, k)
        at = np.searchsorted(hashes, g)
        some = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == g)
        doc = np.searchsorted(first, some, "right") - 1
        inside = some + k <= first[doc + 1]
        some, doc = some[inside], doc[inside]
        many = np.searchsorted(hashes, g[some], "right") - at[some]
        upto = np.cumsum(many)
        for a in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            pair = np.arange(a, min(a + PAIRS, int(upto[-1])))
            w = np.searchsorted(upto, pair, "right")
            x, y = some[w], places[at[some[w]] + pair - (upto[w] - many[w])].astype(np.int64)
            same = wanted.equal(low, start, size, x, y, k)
            item = np.searchsorted(wanted.first, y[same], "right") - 1
            hit = np.unique(x[same])
            hit_at.append(hit)
            hit_to.append(hit + k)
            found.append(np.unique(np.stack([doc[w][same], wanted.ids[item]], 1), axis=0))
    items: dict[int, list[int]] = defaultdict(list)
    for d, i in np.unique(np.concatenate(found), axis=0).tolist():
        items[d].append(i)
    return first, cover(len(h), np.concatenate(hit_at), np.concatenate(hit_to)), items


def benchmark_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most `block` bytes of text, or one item."""
    size, out = 0, []
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates().toLocalIterator():
        n = len(row["text"].encode())
        if out and size + n > block:
            yield out
            size, out = 0, []
        out.append((row["item_id"], row["text"]))
        size += n
    yield out


def scanned(docs: DataFrame, items: list[tuple[int, str]], n: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_words, hits (one bit a word, packed; null if none) and items (their ids as int64; null if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(Windows(items, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches):
            first, hit, found = scan(buf, offs, shared.value)
            bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() if d in found else None for d in range(len(offs) - 1)]
            ids = [np.array(found[d], np.int64).tobytes() if d in found else None for d in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(np.diff(first)), pa.array(bits, pa.binary()), pa.array(ids, pa.binary())], names=["doc_id", "key", "n_words", "hits", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(run, "doc_id long, key long, n_words long, hits binary, items binary")


FOUND = "doc_id long, key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits binary"


def digests(batches: Iterator[pa.RecordBatch], min_items: int) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND from those of `scanned`; hits and items may also be lists of bitmaps and of id lists, of several blocks."""
    none = hashlib.sha256(b"").hexdigest()
    for rows in batches:
        n_hit, n_items, sha, bits = [], [], [], []
        for h, x in zip(rows.column("hits").to_pylist(), rows.column("items").to_pylist()):
            if not x:
                h, ids, name = None, [], none
            else:
                h, x = (h, x) if isinstance(x, list) else ([h], [x])
                h = np.bitwise_or.reduce([np.frombuffer(y, np.uint8) for y in h])
                ids = np.unique(np.concatenate([np.frombuffer(y, np.int64) for y in x])).tolist()
                name = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
            n_hit.append(0 if h is None else int(np.unpackbits(h).sum()))
            n_items.append(len(ids))
            sha.append(name)
            bits.append(None if h is None else h.tobytes())
        n_items = np.array(n_items, np.int64)
        cols = [rows.column("doc_id"), rows.column("key"), rows.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_items >= min_items), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (one bit a word, packed; null if none)."""
    parts = [scanned(docs, items, n) for items in benchmark_blocks(benchmark, block)]
    if len(parts) == 1:
        return parts[0].mapInArrow(lambda batches: digests(batches, min_items), FOUND).drop("key")
    # rows of one id and text come together; each stands in every block's scan once
    out = merged(parts).withColumn("_copy", F.explode(F.expr(f"sequence(1, cast(_rows DIV {len(parts)} AS int))")))
    return out.drop("_copy", "_rows").mapInArrow(lambda batches: digests(batches, min_items), FOUND).drop("key")


def merged(parts: list[DataFrame]) -> DataFrame:
    """A row for each document of several blocks' scans, with the lists of what they found and the number of rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "key", "n_words").agg(F.collect_set("hits").alias("hits"), F.collect_set("items").alias("items"), F.count("*").alias("_rows"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, block: int = BLOCK, spans: bool = True) -> DataFrame:
    """docs without contaminated documents (those with windows of `min_items` or more items, of any blocks); from the
    others the spans of words that are hit are cut out of the text, if `spans`. Columns are those of docs."""
    names, schema = docs.columns, docs.schema
    inner = [f"_in{i}" for i in range(len(names))]  # the operator's columns may clash with the table's
    at_text, at_id = names.index("text"), names.index("doc_id")
    blocks = benchmark_blocks(benchmark, block)
    some = list(itertools.islice(blocks, 2))
    rows = docs.toDF(*inner)
    shared = docs.sparkSession.sparkContext.broadcast(Windows(some[0], n)) if len(some) == 1 else None
    if not shared:
        found = merged([scanned(docs, items, n) for items in itertools.chain(some, blocks)]).drop("_rows").mapInArrow(lambda b: digests(b, min_items), FOUND)
        found = found.filter("n_items > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("hits").alias("_hits"), F.col("contaminated").alias("_gone"))
        mine = F.col(inner[at_id]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(inner[at_text]) == F.col("_key"))
        rows = rows.join(found, mine, "left").filter("_gone IS NULL OR NOT _gone").select(*inner, "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in text_blocks(batches, inner[at_text]):
            keep = np.ones(part.num_rows, bool)
            if shared:
                first, hit, items = scan(buf, offs, shared.value)
                hits = {d: hit[first[d] : first[d + 1]] for d in items}
                for d, ids in items.items():
                    keep[d] = len(ids) < min_items
            else:
                hits = {d: np.unpackbits(np.frombuffer(x, np.uint8)) for d, x in enumerate(part.column("_hits").to_pylist()) if x}
            texts = part.column(at_text)
            if hits and spans:
                start, end, first = words(LOWER[buf], offs, ALNUM)
                new = texts.to_pylist()
                for d, h in hits.items():
                    if keep[d]:
                        new[d] = without_spans(buf, offs[d], offs[d + 1], start[first[d] : first[d + 1]], end[first[d] : first[d + 1]], h[: first[d + 1] - first[d]])
                texts = pa.array(new, texts.type)
            out = [texts if i == at_text else part.column(i) for i in range(len(names))]
            if "n_chars" in names and hits:
                i = names.index("n_chars")
                out[i] = pc.if_else(pc.equal(texts, part.column(at_text)), out[i], pc.utf8_length(texts).cast(out[i].type))
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(keep))

    return rows.mapInArrow(run, schema)


def without_spans(buf: np.ndarray, at: int, to: int, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> str:
    """A document's text without its runs of hit words; what stands between the words of a run goes with them."""
    keep = np.ones(to - at, bool)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        keep[start[a] - at : end[b - 1] - at] = False
    return buf[at:to][keep].tobytes().decode("utf-8", "replace")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[s : s + least(8, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM w), (SELECT DISTINCT k FROM g) WHERE s + k - 1 <= len(w)),
f AS (SELECT p.doc_id, p.s, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.t = g.t),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM f) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, coalesce(n.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
