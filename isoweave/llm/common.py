"""Shared pieces of the training-data operators: shared-folder tables and vectorised text kernels.

Texts travel to Python as Arrow batches and are handled there as flat byte arrays: word bounds, word hashes
and n-gram hashes come from a handful of numpy passes over the bytes of a block of documents, never word by word.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reachable

U64 = np.uint64
#: Bytes of text that one numpy pass takes at a time; a single longer document is taken alone.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]
#: By a number of bytes: the low bits of a little-endian block that belong to them.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session without one a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="isoweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that later tables have replaced."""

    def __init__(self, spark: SparkSession, name: str):
        reachable(spark)
        self.spark, self.top, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.top}/{self.n}"

    def cut(self, frame: DataFrame, texts: bool = False) -> DataFrame:
        """Written and read again: what follows doesn't depend on lost executors' shuffle files. texts: whole texts go to Python."""
        path = self.path()
        with short_batches(self.spark) if texts else nullcontext():
            frame.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()  # lets the context cleaner free the shuffle files behind the table
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for x in frames:
            where = jvm.org.apache.hadoop.fs.Path(x._scratch_path)
            where.getFileSystem(conf).delete(where, True)


# ---------------------------------------------------------------- memory of workers

#: Rows of an Arrow batch of whole texts. Spark's 10,000 may be 30 MB, held in the JVM, there again as buffers double, and in Python.
TEXT_ROWS = 1000
ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches have TEXT_ROWS rows at most."""
    before = spark.conf.get(ROWS_CONF)
    spark.conf.set(ROWS_CONF, str(TEXT_ROWS if int(before) <= 0 else min(int(before), TEXT_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(ROWS_CONF, before)


def give_back() -> None:
    """Returns to the system what this process has freed but kept."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and what it has freed is given back at its end: idle workers stay beside the busy ones."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return go


# ---------------------------------------------------------------- blocks of documents


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most `limit` bytes of text (or one row): (slice, bytes, offsets). Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column).fill_null("" if pa.types.is_string(batch.column(column).type) else b"")
        bufs = col.buffers()
        offs = np.frombuffer(bufs[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 4096)
        for k, x in enumerate((_BASE, _INVERSE)):
            p = np.full(m, x, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of (buf[x] + 1) * BASE**x over i <= x < j."""
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf) + 1)[0][:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of bytes start:end, the same wherever they stand."""
    return (c[end] - c[start]) * powers(len(c))[1][start]


def separators(*ranges: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true where a byte belongs to a word: all but the given bytes."""
    word = np.ones(256, bool)
    for r in ranges:
        word[r if isinstance(r, int) else slice(r[0], r[1] + 1)] = False
    return word


#: Words [^\x20\x09-\x0D]+ ; bytes of UTF-8 from 0x80 on belong to words.
SPACED = separators(0x20, (0x09, 0x0D))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the first word of each document (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = is_word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1] | cut[1:n]
    end[:-1] &= ~m[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words start:end, 8 bytes at a time, each mixed before the next: no two words known to meet."""
    if not len(start):
        return np.zeros(0, U64)
    n = end - start
    eight = np.ndarray(len(buf) + 1, "<u8", padded(buf), strides=(1,))
    out = mix(n.astype(U64) + U64(_BASE))
    which, at = np.arange(len(n)), 0
    while len(which) and at < 256:
        block = eight[start[which] + at] & _MASKS[np.minimum(n[which] - at, 8)]
        out[which] = mix((out[which] ^ block) + U64(at))
        at += 8
        which = which[n[which] > at]
    for i in which.tolist():  # the rest of very long words
        out[i] ^= U64(int.from_bytes(hashlib.blake2b(buf[start[i] + at : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


def padded(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([buf, np.zeros(8, np.uint8)])


def equal_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of x from a are those of y from b, 8 at a time for all pairs that still agree. x, y: `padded`."""
    x, y = (np.ndarray(len(z) - 7, "<u8", z, strides=(1,)) for z in (x, y))
    same, which, at = np.ones(len(a), bool), np.flatnonzero(n > 0), 0
    while len(which):
        agree = (x[a[which] + at] ^ y[b[which] + at]) & _MASKS[np.minimum(n[which] - at, 8)] == 0
        same[which[~agree]] = False
        at += 8
        which = which[agree & (n[which] > at)]
    return same


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive hashes; those that cross documents are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        out = out * U64(_BASE) + h[j : len(h) - n + 1 + j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of 0:n that lie in any start:end."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    f = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(f == 1), np.flatnonzero(f == -1)


# ---------------------------------------------------------------- joins


#: Keys that may be broadcast for having many rows: fewer than this can have more than 1/HOT_KEYS of all rows each.
HOT_KEYS = 4096


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """big with small's columns (one row a key; `rows` counts big's rows of that key, and goes). No key takes many rows
    of big to one task: those with over total / HOT_KEYS rows, fewer than HOT_KEYS, are broadcast. how: inner or left."""
    many = F.col(rows) > total / HOT_KEYS
    hot, rest = small.filter(many).drop(rows), small.filter(~many).drop(rows)
    others = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return big.join(F.broadcast(hot), keys).unionByName(others)


#: Bits of the largest map of ids that is broadcast: 64 in a row, so 2**20 rows of two numbers.
ID_BITS = 1 << 26


def split_by_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs in two parts, with docs' columns and rows: those whose `column` may be in ids.column (all that are, and a few in
    a hundred of the others while there are under ID_BITS / 16 ids; beyond that more of them), and those for which it can't.

    Each id's hash chooses a word of a bit map and three bits in it; the map, of bounded size, is made by partial
    aggregates and broadcast, and docs meet it in a hash join: no text is dealt or sent to Python for it. A null is an id like any other.
    """
    n, size = ids.count(), 1 << 4
    while size * 64 < min(16 * n, ID_BITS):
        size *= 2

    def word_and_bits(frame: DataFrame) -> tuple[Column, Column]:
        h = F.xxhash64(frame[column].cast("long"))
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
        return h.bitwiseAND(F.lit(size - 1)), one(32).bitwiseOR(one(40)).bitwiseOR(one(48))

    word, bits = word_and_bits(ids)
    marks = F.broadcast(ids.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    word, bits = word_and_bits(docs)
    there = (word == marks["word"]) & (marks["bits"].bitwiseAND(bits) == bits)
    return docs.join(marks, there, "left_semi"), docs.join(marks, there, "left_anti")
