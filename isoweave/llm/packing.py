"""Best-fit packing of documents into training sequences of several permitted lengths.

A document's length is its number of words (runs of other than space and bytes 9-13) and one end mark. Documents
longer than the largest length are cut into full pieces and a rest. Pieces are dealt by a hash of doc_id to shards
of about `shard` pieces, as many as the input needs; in a shard, longest first, each goes to the open bin with the
least room that still holds it, or else opens the bin size with the least cost: a size's own cost (linear, and
quadratic for attention) less what its free room is worth at the cheapest price of a place, as far as remaining
pieces can fill it. At last each bin shrinks to the smallest permitted size that holds its contents.

Defined cases: null and empty texts have length 1. Ties in length go by doc_id and piece, ties in room to the
newest bin. Repeated rows are packed each. Extra columns are ignored. An empty table gives no rows. Nothing is
dropped: every place of every document is in exactly one piece of exactly one bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIZES = (256, 512, 1024, 2048, 4096)
SHARD = 20_000
SCHEMA = "doc_id long, piece int, piece_at long, n_tokens int, bin_id long, bin_size int, bin_at int"


def cost(size: int, largest: int) -> float:
    return size + 0.25 * size * size / largest


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Lengths in descending order, none above the largest size: the bin and the place in it of each, and the bins' sizes."""
    sizes = tuple(sorted(sizes))
    price = min(cost(c, sizes[-1]) / c for c in sizes)
    left = sum(lengths)
    open_bins: dict[int, list[int]] = {}  # by free room
    rooms = 0  # bit r is set if a bin has r free places
    bins, places, used = [], [], []
    for n in lengths:
        left -= n
        if fit := (rooms >> n) << n:
            room = (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
            room -= n
        else:
            size = min((c for c in sizes if c >= n), key=lambda c: cost(c, sizes[-1]) - price * min(c - n, left))
            b, room = len(used), size - n
            used.append(0)
        bins.append(b)
        places.append(used[b])
        used[b] += n
        if room:
            open_bins.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, places, [next(c for c in sizes if c >= u) for u in used]


def pack_shards(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and descending length; a shard may span batches."""

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        shard = t.column("shard")[0].as_py()
        bins, places, final = pack(t.column("n_tokens").to_pylist(), sizes)
        b = np.array(bins, np.int64)
        cols = [t.column(c).combine_chunks() for c in ("doc_id", "piece", "piece_at", "n_tokens")]
        return pa.RecordBatch.from_arrays([*cols, pa.array((shard << 32) + b), pa.array(np.array(final, np.int32)[b]), pa.array(places, pa.int32())], names=["doc_id", "piece", "piece_at", "n_tokens", "bin_id", "bin_size", "bin_at"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("shard")[0].as_py() != shards[a]:
                yield packed(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield packed(held)


def word_count(text: Column) -> Column:
    """Words and one end mark; regexp_count only counts, so no array of words is made."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + 1


def pack_documents(docs: DataFrame, length: Column | None = None, sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, piece, piece_at (its first place in the document), n_tokens, bin_id, bin_size, bin_at."""
    top = max(sizes)
    rows = docs.select(F.col("doc_id").cast("long"), (word_count(F.col("text")) if length is None else length).cast("long").alias("n"))
    pieces = rows.select("doc_id", "n", F.explode_outer(F.sequence(F.lit(0), ((F.col("n") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("piece_at"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int").alias("n_tokens"))
    shards = max(1, math.ceil(docs.count() / shard))
    spark = docs.sparkSession
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    order = ["shard", F.desc("n_tokens"), "doc_id", "piece"]
    return pieces.repartition(parts, "shard").sortWithinPartitions(*order).mapInArrow(lambda batches: pack_shards(batches, sizes), SCHEMA)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
