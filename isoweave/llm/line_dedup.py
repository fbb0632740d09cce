"""Line dedup: content-defined chunks of lines, removed where an equal chunk of at least two lines stood before.

Native: DataFrame functions only. A line's hash and those of the `window` - 1 lines before it in its chunk's
neighbourhood form a rolling hash; a chunk ends after a line whose rolling hash is 0 modulo `divisor`, so bounds
depend on content alone and survive shifts. With `least` 2 a line ends a chunk only if the line before did not, so
that no chunk but a text's last has a single line; within a run of lines that could end one, every other does. Chunk hashes are counted over every document (partial counts before
the shuffle); chunks whose hash repeats are fetched and grouped by their bytes, and of equal ones the first by
(doc_id, place) stays. Hot chunks meet in counts and minima with partial aggregates; of them only these come back,
broadcast, to the documents that have them.

Defined cases: a null text stays null and an empty one empty, with no lines removed. Texts of any length are taken
whole. Chunks without a word and chunks of one line are never removed. Ties in bytes go to the smaller doc_id, then
the earlier place. Repeated rows (one doc_id and text) are one document and all get the same removals; of rows of one
doc_id with different texts each is judged by itself. A null doc_id comes first. Extra columns, whatever their names,
are returned as they came; `_n_lines`, `_n_removed` and `_n_chunks` follow them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join, table

WINDOW, DIVISOR, LEAST = 2, 3, 2


def chunk_ends(lines: str, window: int, divisor: int, least: int) -> Column:
    """Of each line: whether its chunk ends there."""

    def bound(line: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(*(F.get(lines, i - j) for j in range(window))), F.lit(divisor)) == 0

    last = lambda i: i == F.size(lines) - 1
    if least == 1:
        return F.transform(lines, lambda line, i: bound(line, i) | last(i))
    # a digit a line, and a bound before the first: of neighbouring bounds, from the left, the second goes
    marks = F.array_join(F.transform(lines, lambda line, i: F.when(bound(line, i), "1").otherwise("0")), "")
    marks = F.regexp_replace(F.concat(F.lit("1"), marks), "11", "10")
    return F.transform(F.split(F.substring(marks, 2, 1 << 30), ""), lambda mark, i: (mark == "1") | last(i))


def chunked(docs: DataFrame, window: int, divisor: int, least: int) -> DataFrame:
    """One row a document: _id, _lines and _ends, the places (from 1) of the last lines of its chunks."""
    out = docs.select("_id", F.split("_text", "\n").alias("_lines"))
    out = out.withColumn("_flags", chunk_ends("_lines", window, divisor, least))
    return out.withColumn("_ends", F.filter(F.transform("_flags", lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())).drop("_flags")


def chunk_structs(frame: DataFrame) -> DataFrame:
    """frame with _chunks: of each chunk its first line's place from 0, the number of lines and the hash of its text."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1))
    chunk = lambda e, i: F.struct(begin(i).alias("at"), (e - begin(i)).alias("n"), F.xxhash64(F.slice("_lines", begin(i) + 1, e - begin(i))).alias("hash"))
    return frame.withColumn("_chunks", F.filter(F.transform("_ends", chunk), lambda c: c["n"] > 1))


def repeated_chunks(docs: DataFrame, scratch: Scratch, window: int = WINDOW, divisor: int = DIVISOR, least: int = 1) -> DataFrame:
    """(_id, _gone): the lines from 0 that repeated chunks take from each document that loses any. docs: _id, _text."""
    split = chunk_structs(chunked(docs, window, divisor, least))
    marks = scratch.cut(split.select("_id", F.explode_outer("_chunks").alias("c")).filter("c IS NOT NULL").select("_id", "c.at", "c.n", "c.hash"))
    often = scratch.cut(marks.groupBy("hash").agg(F.count("*").alias("k")).filter("k > 1"))
    wanted = hot_join(marks, often, ["hash"], "k", marks.count()).distinct().groupBy("_id").agg(F.collect_list(F.struct("at", "n", "hash")).alias("_want"))
    texts = docs.select("_id", "_text").join(wanted.hint("merge"), "_id").select("_id", F.split("_text", "\n").alias("_lines"), "_want")
    texts = texts.select("_id", F.explode_outer(F.transform("_want", lambda c: F.struct(c["at"], c["n"], c["hash"], F.array_join(F.slice("_lines", c["at"] + 1, c["n"]), "\n").alias("bytes")))).alias("c"))
    texts = scratch.cut(texts.filter("c IS NOT NULL").select("_id", "c.at", "c.n", "c.hash", "c.bytes").filter(F.translate("bytes", " \t\n\x0b\f\r", "") != ""))
    scratch.drop(marks, often)
    first = scratch.cut(texts.groupBy("hash", "bytes").agg(F.min(F.struct("_id", "at")).alias("first"), F.count("*").alias("k")).filter("k > 1"))
    # hot chunks are few, and together no longer than HOT_KEYS chunks of mean length: what each has times its length is part of the input
    gone = hot_join(texts, first, ["hash", "bytes"], "k", texts.count()).filter((F.col("_id") != F.col("first._id")) | (F.col("at") != F.col("first.at")))
    out = scratch.cut(gone.select("_id", "at", "n").distinct().groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_gone")))
    scratch.drop(texts, first)
    return out


def dedup_lines(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = 1) -> DataFrame:
    """docs with `text` shortened, and after its own columns _n_lines, _n_removed and _n_chunks of each document."""
    names = [f"_in{i}" for i in range(len(docs.columns))]  # the operator's columns may clash with the table's
    at = docs.columns.index(text)
    rows = docs.toDF(*names)
    # rows of one doc_id with different texts are different documents
    rows = rows.withColumn("_id", F.struct(F.col(names[docs.columns.index(doc_id)]).alias("id"), F.xxhash64(names[at]).alias("h"))).withColumnRenamed(names[at], "_text")
    gone = repeated_chunks(rows.select("_id", "_text"), scratch, window, divisor, least)
    # neither side has a bound, so neither is broadcast, at any size
    out = rows.join(gone.hint("merge"), "_id", "left").withColumn("_lines", F.split("_text", "\n"))
    # the removed chunks are disjoint and in order: what stays are the stretches between them
    till = lambda i: F.coalesce(F.get("_gone", i)["at"], F.size("_lines"))
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_gone", i - 1)["at"] + F.get("_gone", i - 1)["n"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda i: F.slice("_lines", since(i) + 1, till(i) - since(i))))
    removed = F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, c: a + c["n"]), F.lit(0))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("_text")))
    counts = [F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("_n_lines"), removed.cast("long").alias("_n_removed"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_chunks")]
    return out.select(*(F.col("_kept" if i == at else names[i]).alias(c) for i, c in enumerate(docs.columns)), *counts)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_chunks removed, n_chars left and kept_sha256 of what is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op10"), least=LEAST)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_chunks").alias("n_chunks"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))
