"""Token ids in a content-addressed store.

Layout, below a folder of its own (Parquet; ids are little-endian, 16 bits where the vocabulary allows, else 32):
  chunks    digest, data, n_refs, row, idx   each distinct run of ids once, with the first place that has it
  recipes   row, doc_id, at, n_tokens, digests, root   in ascending doc_id; digests are those of the document's chunks
  manifest  part, docs, tokens, root   a Merkle root over the roots of a part's recipes; part -1 holds the whole
A document's row is its number as it was read; it names places, so that repeated rows are documents of their own.

A rolling hash over the last `WINDOW` ids ends a chunk where it is 0 modulo `MEAN`, so equal passages give equal
chunks wherever they stand. Reading joins documents with their chunks again, and every digest, document root and
manifest root is computed anew and compared; a mismatch raises.

Distinct words are encoded once a worker, in a bounded table, found by hash and compared as bytes; a text with a
special token's string, or with a word that only the hash takes for another, is encoded whole. With a tokenizer whose
normaliser or splitting rule is another than that which the table is made for, all texts are encoded whole.

Defined cases: null and empty texts have the end id only. Texts of any length are taken whole. Repeated rows are each
encoded, stored and returned, one after the other; so are rows of one doc_id with different texts, in no set order. A
null doc_id comes first. Extra columns are ignored. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, equal_spans, gram_hashes, hot_join, lean, mix, padded, separators, short_batches, table, text_blocks, word_hashes, words

WINDOW, MEAN, END = 8, 512, 1
#: Distinct pieces that a worker keeps encoded; beyond, it starts over.
CACHE_WORDS = 1_000_000
#: Marks that no pre-token shares with letters or digits, and the bytes that surely part words.
MARKED = np.zeros(256, bool)
MARKED[list(b".,;:!?%*#$&|")] = True
PARTED = separators(0x20, 0x0A)
# The rules of a tokenizer file whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n values at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def all_letters(s: str) -> bool:
    """Whether s is letters alone, as it stands and as the normaliser leaves it."""
    return s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())


class Merkle:
    """The root that `merkle` gives, of leaves that come one by one; holds a node a level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = node
                return
            node, self.levels[i] = digest(left + node), None
        self.levels.append(node)

    def root(self) -> bytes:
        out: bytes | None = None
        for left in self.levels:
            out = out if left is None else left if out is None else digest(left + out)
        return digest(b"") if out is None else out


class HashTable:
    """int32 values by 64-bit hashes: open addressing, looked up and filled by whole arrays; grows to stay half empty."""

    def __init__(self, bits: int = 16):
        self.used = 0
        self.keys, self.values, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 if there is none."""
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), h & self.mask
        while len(left):
            k = self.keys[slot[left]]
            hit = k == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (k != 0)]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Hashes that are all different and not there yet."""
        if 2 * (self.used + len(h)) > len(self.keys):
            there = np.flatnonzero(self.keys)
            keys, old = self.keys[there], self.values[there]
            self.__init__((2 * (self.used + len(h))).bit_length())
            self.put(keys, old)
        self.used += len(h)
        left, slot = np.arange(len(h)), h & self.mask
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = h[free], values[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class WordEncoder:
    """encode(texts): ids of all texts and where each text's begin.

    White space parts words, and a run of letters and the marks after it are pre-tokens of their own; so each distinct
    one is encoded once and found again by the 64-bit hash of its bytes, with ASCII letters in lower case, and these
    bytes. A word of another build is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        rules = json.loads(self.whole.to_str())
        self.by_words = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.type = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.table, self.count = HashTable(), 1  # piece 0 has no ids
        self.at, self.n, self.ids, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.type), 0
        # the bytes of each piece, and 8 more
        self.begin, self.size, self.raw, self.full = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint8), 0

    def pieces(self, low: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, letters: bool) -> np.ndarray:
        """The number of each piece start:end; new ones are encoded. -3 for those whose bytes are others than those of
        their hash; with `letters`, -2 for those that aren't runs of letters."""
        out = self.table.get(h)
        if len(missing := np.flatnonzero(out == -1)):
            out[missing] = self.added(low, h[missing], start[missing], end[missing], letters)
        some = np.flatnonzero(out > 0)
        k, n = out[some], (end - start)[some]
        same = self.size[k] == n
        same[same] = equal_spans(padded(low), start[some[same]], self.raw, self.begin[k[same]], n[same])
        out[some[~same]] = -3
        return out

    def added(self, low: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, letters: bool) -> np.ndarray:
        """The numbers of pieces that aren't in the table yet, after putting them there."""
        missing = np.arange(len(h))
        fresh, first = np.unique(h[missing], return_index=True)
        first, flat = missing[first], low.tobytes()
        texts = [flat[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
        value = np.full(len(texts), -2, np.int32)
        fine = np.flatnonzero(np.fromiter(map(all_letters, texts), bool, len(texts))) if letters else np.arange(len(texts))
        for i in range(0, len(fine), 5000):
            which = fine[i : i + 5000]
            some = [texts[k] for k in which.tolist()]
            begins = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            got = self.whole.encode(" ".join(some), add_special_tokens=False)
            word = np.searchsorted(begins, np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), "right")
            n, k = np.bincount(word, minlength=len(some)), self.count
            self.ids = grown(self.ids, self.used + len(word))
            self.ids[self.used : self.used + len(word)] = got.ids
            self.at, self.n = grown(self.at, k + len(some)), grown(self.n, k + len(some))
            self.at[k : k + len(some)] = self.used + np.cumsum(n) - n
            self.n[k : k + len(some)] = n
            value[which] = np.arange(k, k + len(some))
            raw = np.frombuffer("".join(some).encode(), np.uint8)
            sizes = (end - start)[first[which]]
            self.begin, self.size, self.raw = grown(self.begin, k + len(some)), grown(self.size, k + len(some)), grown(self.raw, self.full + len(raw) + 8)
            self.begin[k : k + len(some)] = self.full + np.cumsum(sizes) - sizes
            self.size[k : k + len(some)] = sizes
            self.raw[self.full : self.full + len(raw)] = raw
            self.full += len(raw)
            self.used, self.count = self.used + len(word), k + len(some)
        self.table.put(fresh, value)
        return self.table.get(h)

    def encode_block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            got = self.whole.encode_batch([buf[a:b].tobytes().decode() for a, b in zip(offs, offs[1:])], add_special_tokens=False)
            return np.array([i for g in got for i in g.ids], self.type), np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)
        if self.count > CACHE_WORDS:
            self.clear()
        low, odd = LOWER[buf], np.zeros(0, np.int64)
        start, end, first = words(low, offs, PARTED)
        if len(start):
            last = np.maximum.accumulate(np.where(MARKED[low], 0, np.arange(1, len(low) + 1)))
            tail = np.maximum(last[end - 1], start)
            hashed = lambda a, b: np.maximum(word_hashes(low, a, b), np.uint64(1))
            part = np.zeros((len(start), 2), np.int32)
            some = np.flatnonzero(tail > start)
            part[some, 0] = self.pieces(low, hashed(start[some], tail[some]), start[some], tail[some], True)
            some = np.flatnonzero(end > tail)
            part[some, 1] = self.pieces(low, hashed(tail[some], end[some]), tail[some], end[some], False)
            some = np.flatnonzero(part[:, 0] == -2)
            part[some, 1] = 0
            part[some, 0] = self.pieces(low, np.maximum(mix(hashed(start[some], end[some]) ^ np.uint64(0x5555)), np.uint64(1)), start[some], end[some], False)
            # words that a collision hides: their documents are encoded whole
            odd = np.searchsorted(first, np.flatnonzero((part == -3).any(1)), "right") - 1
            part = np.maximum(part, 0).reshape(-1)
        else:
            part = np.zeros(0, np.int32)
        n = self.n[part]
        done = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[part] - done + n, n) + np.arange(done[-1] if len(done) else 0)]
        upto = np.concatenate(([0], done))[2 * first]
        # texts with a special token's string are encoded as they are
        bar = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C)) if len(buf) > 1 else np.zeros(0, np.int64)
        texts = {d: buf[offs[d] : offs[d + 1]].tobytes() for d in np.unique(np.concatenate([odd, np.searchsorted(offs, bar, "right") - 1])).tolist()}
        texts = {d: t for d, t in texts.items() if d in odd or any(x in t for x in self.special)}
        if not texts:
            return ids, upto
        parts = [np.array(self.whole.encode(texts[d].decode(), add_special_tokens=False).ids, self.type) if d in texts else ids[a:b] for d, (a, b) in enumerate(zip(upto, upto[1:]))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.encode_block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))


_encoders: dict[str, WordEncoder] = {}


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node moves up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


def chunk_bounds(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends of chunks in the ids of several documents; documents always end one."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    cut = np.flatnonzero(gram_hashes(h, WINDOW) % np.uint64(MEAN) == 0) + WINDOW
    doc = np.searchsorted(offs, cut, "left")
    inside = cut - offs[np.maximum(doc - 1, 0)] >= WINDOW  # the window must lie in one document
    return np.unique(np.concatenate([cut[inside], offs[1:]]))


STAGED = "kind int, row long, doc_id long, idx int, n_tokens long, digest binary, data binary, n_refs long"


def encode_and_cut(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of STAGED: a recipe for each document (kind 1), and each distinct chunk of a block of documents (kind 0)."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    from pyspark import TaskContext

    encoder, number = _encoders[path], TaskContext.get().partitionId() << 40
    for rows, buf, offs in text_blocks(batches):
        ids, offs = encoder.encode_block(buf, offs)
        n_docs = rows.num_rows
        full = np.empty(len(ids) + n_docs, ids.dtype)
        ends = offs[1:] + np.arange(1, n_docs + 1)
        own = np.ones(len(full), bool)
        own[ends - 1] = False
        full[own], full[~own] = ids, END
        offs = np.concatenate(([0], ends))
        bounds = chunk_bounds(full, offs)
        raw, width = full.astype(full.dtype.newbyteorder("<")).tobytes(), full.dtype.itemsize
        begins = np.concatenate(([0], bounds[:-1]))
        doc = np.searchsorted(offs, begins, "right") - 1
        first = np.searchsorted(begins, offs[:-1])
        refs: Counter[bytes] = Counter()
        owner: dict[bytes, tuple[int, int, int, bytes]] = {}  # the first place in the block, which comes in order
        lists: list[list[bytes]] = [[] for _ in range(n_docs)]
        names = rows.column("doc_id").to_pylist()
        for k, (a, b, d) in enumerate(zip(begins.tolist(), bounds.tolist(), doc.tolist())):
            data = raw[a * width : b * width]
            key = digest(data)
            refs[key] += 1
            if key not in owner:
                owner[key] = (number + d, k - int(first[d]), b - a, data)
            lists[d].append(key)
        keys = list(owner)
        cols = [
            [1] * n_docs + [0] * len(keys),
            list(range(number, number + n_docs)) + [owner[k][0] for k in keys],
            names + [None] * len(keys),
            [0] * n_docs + [owner[k][1] for k in keys],
            np.diff(offs).tolist() + [owner[k][2] for k in keys],
            [b"".join(x) for x in lists] + keys,
            [None] * n_docs + [owner[k][3] for k in keys],
            [0] * n_docs + [refs[k] for k in keys],
        ]
        number += n_docs
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in STAGED.split(", ")])


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, row and idx: the first of each digest with the sum of n_refs, batch by batch."""
    held: pa.RecordBatch | None = None
    held_refs = 0
    for batch in batches:
        keys = batch.column("digest").to_pylist()
        n = np.asarray(batch.column("n_refs"))
        start = np.array([i for i, k in enumerate(keys) if not i or k != keys[i - 1]], np.int64)
        if not len(start):
            continue
        sums = np.add.reduceat(n, start)
        if held is not None and held.column("digest")[0].as_py() == keys[0]:
            held_refs += int(sums[0])
            start, sums = start[1:], sums[1:]
            if not len(start):
                continue
        if held is not None:
            yield with_refs(held, np.array([held_refs]))
        if len(start) > 1:
            yield with_refs(batch.take(pa.array(start[:-1])), sums[:-1])
        held, held_refs = batch.take(pa.array(start[-1:])), int(sums[-1])
    if held is not None:
        yield with_refs(held, np.array([held_refs]))


def with_refs(rows: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column("digest"), rows.column("data"), pa.array(n, pa.int64()), rows.column("row"), rows.column("idx")], names=["digest", "data", "n_refs", "row", "idx"])


def local_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes in order, with the ids before each in its part and its Merkle root."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column("n_tokens"))
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        lists = batch.column("digest").to_pylist()
        roots = [merkle([x[i : i + 20] for i in range(0, len(x), 20)]) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column("row"), batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), batch.column("digest"), pa.array(roots, pa.binary())], names=["part", "row", "doc_id", "at", "n_tokens", "digests", "root"])


def part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One manifest row for each run of rows of one part; rows are sorted by part and place."""
    part, docs, tokens, tree = None, 0, 0, Merkle()
    row = lambda: pa.RecordBatch.from_pylist([{"part": part, "docs": docs, "tokens": tokens, "root": tree.root()}], pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())]))
    for batch in batches:
        for p, n, root in zip(batch.column("part").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist()):
            if p != part:
                if part is not None:
                    yield row()
                part, docs, tokens, tree = p, 0, 0, Merkle()
            docs, tokens = docs + 1, tokens + n
            tree.add(root)
    if part is not None:
        yield row()


def manifest_of(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """Of each part: its number, documents, ids and root, in order; one row a part reaches the driver."""
    rows = recipes.select("part", "at", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "at").mapInArrow(part_roots, "part int, docs long, tokens long, root binary")
    return sorted((r["part"], r["docs"], r["tokens"], bytes(r["root"])) for r in rows.collect())


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """The store of all documents below `path`."""
    spark = docs.sparkSession
    staged = f"{path}/staged"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(lambda b: encode_and_cut(b, tokenizer)), STAGED)
    with short_batches(spark):
        rows.write.partitionBy("kind").option("compression", "zstd").parquet(staged)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = spark.read.schema(STAGED).parquet(staged)
    chunks = back.filter("kind = 0").select("digest", "row", "idx", "data", "n_refs")
    chunks.repartition(n, "digest").sortWithinPartitions("digest", "row", "idx").mapInArrow(lean(first_of_each), "digest binary, data binary, n_refs long, row long, idx int").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = back.filter("kind = 1").select("row", "doc_id", "n_tokens", "digest")
    recipes.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(lean(local_starts), "part int, row long, doc_id long, at long, n_tokens long, digests binary, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = manifest_of(spark.read.parquet(f"{path}/recipes"))
    top = (-1, sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([p[3] for p in parts]))
    spark.createDataFrame([top, *parts], "part int, docs long, tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    gone = spark._jvm.org.apache.hadoop.fs.Path(staged)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    spark.sparkContext._jvm.System.gc()


READ = "doc_id long, start long, n_tokens long, ids binary"


def assemble(batches: Iterator[pa.RecordBatch], width: int, take: object) -> Iterator[pa.RecordBatch]:
    """Documents from rows sorted by row and idx: the recipe (idx -1), then its chunks; all hashes are verified."""
    head, leaves, parts, out = None, [], [], []

    def finish() -> None:
        if head is None:
            return
        _, doc, start, n, root = head
        data = b"".join(parts)
        if merkle(leaves) != root or len(data) != n * width:
            raise ValueError(f"document {doc}: the chunks don't give its root")
        out.append((doc, start, n, data))

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("row", "idx", "doc_id", "start", "n_tokens", "root", "data")]
        for row, idx, doc, start, n, root, data in zip(*cols):
            if idx == -1:
                finish()
                head, leaves, parts = (row, doc, start, n, root), [], []
            else:
                if head is None or head[0] != row or idx != len(leaves):
                    raise ValueError(f"row {row}: its chunks aren't one of each place")
                leaves.append(digest(data))
                parts.append(data)
        if len(out) >= 256:
            yield take(out)
            out = []
    finish()
    if out:
        yield take(out)


def read_store(spark: SparkSession, path: str, width: int, take: object, schema: str) -> DataFrame:
    """take() makes a batch of `schema` from a list of (doc_id, start, n_tokens, bytes of ids)."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks")
    manifest = {r["part"]: (r["docs"], r["tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()}
    parts = manifest_of(recipes)
    if {p[0]: p[1:] for p in parts} | {-1: (sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([p[3] for p in parts]))} != manifest:
        raise ValueError("the recipes don't give the manifest's roots")
    before, base = 0, []
    for part, _, tokens, _ in parts:
        base.append((part, before))
        before += tokens
    starts = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # a row a part
    heads = recipes.join(starts, "part").select("row", F.lit(-1).alias("idx"), "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "root", F.lit(None).cast("binary").alias("data"))
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("root")]
    own = chunks.select("row", "idx", *none, "data")
    refs = recipes.select("row", F.posexplode_outer(F.transform(F.sequence(F.lit(0), (F.length("digests") / 20).cast("int") - 1), lambda i: F.substring("digests", i * 20 + 1, 20))).alias("idx", "digest"))
    shared = chunks.filter("n_refs > 1").select("digest", "data", F.col("row").alias("of"), F.col("idx").alias("of_idx"), "n_refs")
    # hot chunks are few, and together no longer than HOT_KEYS chunks of mean length: what each has times its length is part of the input
    total = chunks.agg(F.sum("n_refs")).first()[0] or 0
    foreign = hot_join(refs, shared, ["digest"], "n_refs", total).filter((F.col("row") != F.col("of")) | (F.col("idx") != F.col("of_idx"))).select("row", "idx", *none, "data")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.unionByName(own).unionByName(foreign).repartition(n, "row").sortWithinPartitions("row", "idx")
    return rows.mapInArrow(lean(lambda b: assemble(b, width, take)), schema)


def crc_rows(width: int) -> object:
    def take(docs: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        crc = [zlib.crc32(np.frombuffer(d, f"<u{width}").astype("<u4").tobytes()) for _, _, _, d in docs]
        cols = [[x[0] for x in docs], [x[1] for x in docs], [x[2] for x in docs], crc]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return take


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, tokenizer = Scratch(spark, "op4").path(), public_tokenizers.path("word_bpe_49k.json")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer)
    width = WordEncoder(tokenizer).type().itemsize
    return read_store(spark, path, width, crc_rows(width), "doc_id long, start long, n_tokens long, ids_crc32 long")
