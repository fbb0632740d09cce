"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio of trusted against raw prose.

Native: DataFrame functions only. Words are runs of other than space and bytes 9-13. A document fails the base
rules with fewer than `min_words` words, or with over `max_repeat_percent` % of its words in 5-word windows
that stand in it twice or more. The method's verdict: the words and pairs of neighbours are hashed to
`buckets` cells of two multinomials with add-one smoothing, one counted over every document (raw), one over the
trusted texts (target); a document's score is the mean over its n-grams of log(target / raw), and it is kept if
that is at least `threshold`. Counting takes every document; what comes to the driver is one number per bucket.

Defined cases: null and empty texts have no words, score 0 and fail the base rules. Texts of any length are taken
whole; windows are sorted, so the work grows as n log n at most. Ties at the threshold are kept. Repeated rows are judged each by itself. Extra columns are ignored, and returned by `quality_filter`.
With no trusted n-gram at all the ratio is flat and every document that passes the base rules is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 14
THRESHOLD = -0.9


def word_list(text: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _hash, the hashes of its words, and the base counts; all projections, so nothing is dealt anew."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    out = docs.select("*", word_list(F.col(text)).alias("_words"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("_lines"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.select("*", F.size("_words").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")).drop("_lines")
    out = out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i: F.xxhash64(*(F.get("_hash", i + j) for j in range(5)))
    out = out.withColumn("_windows", F.when(F.col("n_words") > 5, F.transform(F.sequence(F.lit(0), F.size("_hash") - 5), at)))
    # a document whose windows all differ, as most do, is done here; those of others are sorted with their places, and
    # neighbours of equal hashes are compared as words
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    words = lambda i: F.slice("_words", i + 1, 5)
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (words(x["i"]) == words(y["i"])), F.lit(False))
    near = F.transform("_sorted", lambda x, k: F.when((k > 0) & same(x, F.get("_sorted", k - 1)) | same(x, F.get("_sorted", k + 1)), x["i"]))
    out = out.withColumn("_hit", F.array_sort(F.filter(near, lambda i: i.isNotNull())))
    # fold over the starts of repeated windows: words covered so far and the end of the last covered stretch
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_hit", start, lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(a["end"], i)).alias("n"), (i + 5).alias("end")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_hit").isNotNull(), covered), F.lit(0)).cast("long")).drop("_sorted", "_hit", "_windows", "_words")


def with_grams(frame: DataFrame, buckets: int) -> DataFrame:
    """frame with _grams, the buckets of the hashes in _hash and of their pairs; buckets is a power of two."""
    cell = lambda h: h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")
    one = F.transform("_hash", cell)
    after = F.slice("_hash", 2, F.greatest(F.size("_hash") - 1, F.lit(0)))
    two = F.transform(after, lambda h, i: cell(F.shiftrightunsigned(F.get("_hash", i), 20).bitwiseXOR(h)))
    return frame.withColumn("_grams", F.concat(one, two))


def log_ratios(raw: DataFrame, target: DataFrame, buckets: int) -> list[float]:
    """log(target / raw) of each bucket; raw and target have _grams. One row a bucket, at most, reaches the driver."""
    # explode_outer, as explode would push a filter on the array below and repeat its expressions there
    count = lambda f, name: f.select(F.explode_outer("_grams").alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.count("*").alias(name))
    got = count(raw, "r").join(count(target, "t"), "b", "full_outer").na.fill(0)
    r, t = [1] * buckets, [1] * buckets
    for row in got.collect():
        r[row["b"]] += row["r"]
        t[row["b"]] += row["t"]
    nr, nt = sum(r), sum(t)
    if nt == buckets:
        return [0.0] * buckets
    return [math.log(t[i] / nt) - math.log(r[i] / nr) for i in range(buckets)]


def quality_scores(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """docs with the base counts, base_failed, score and kept. trusted: a frame with texts of the same column name."""
    grams = lambda f: with_grams(f.select(F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w)).alias("_hash")), buckets)
    ratios = F.lit(log_ratios(grams(docs), grams(trusted), buckets))
    out = with_grams(base_counts(docs, text), buckets)
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    out = out.withColumn("score", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))).drop("_grams", "_hash")
    # row numbers in the verdicts keep a filter on them above the projections, whose expressions it would else repeat
    here = F.monotonically_increasing_id() >= 0
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed & here).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & here)


COUNTS = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_filter(docs: DataFrame, trusted: DataFrame, **options: object) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    names = [f"_in{i}" for i in range(len(docs.columns))]  # the operator's columns may clash with the table's
    at = docs.columns.index("text")
    out = quality_scores(docs.toDF(*names), trusted.select(F.col("text").alias(names[at])), text=names[at], **options)
    return out.filter("kept").select(*names).toDF(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_words", *COUNTS, "base_failed", "kept", "score")
