"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text, each present or not: its words and pairs of neighbours, the shapes of words (letter case,
digits, symbols, length class) in runs of one to three, whether neighbours repeat, and in coarse steps how much of the text each
shape takes; all hashed to `DIMENSIONS` cells. The ratio r of a cell is the log of its smoothed share among
documents of class 1 to that among class 0. A document's vector is r at its cells, scaled to length 1; hinge loss
is minimised by dual coordinate descent, and the margin goes through a logistic curve.

The fit takes at most `SAMPLE` labelled rows, those with the least hash of doc_id among the rows that may be
learned from (a documented bound: their cells are held by the driver); every document is scored in one pass.

Defined cases: null and empty texts have a single cell and get its score. Labels that are null are not learned
from. Of repeated labels for a doc_id each counts. With one class only, all scores are 0.5 + 0.5 * (that class is
1) - 0.25, that is 0.75 or 0.25; with no labels 0.5. Ties at 0.5 are predicted 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, mix, table, text_blocks, word_hashes, words

DIMENSIONS, SAMPLE, EPOCHS, PENALTY = 1 << 18, 8000, 20, 1.0
_CLASSES = [(65, 90), (97, 122), (48, 57), (128, 255)]  # upper case, lower case, digits, beyond ASCII


def cells(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a block's documents: (document, cell), each once, in order."""
    start, end, first = words(buf, offs, SPACED)
    n_docs, per = len(offs) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), per)
    h = word_hashes(buf, start, end)
    shape = np.minimum(end - start, 15) // 4
    other = end - start
    for k, (a, b) in enumerate(_CLASSES):
        c = np.concatenate(([0], np.cumsum((buf >= a) & (buf <= b))))
        n = c[end] - c[start]
        shape |= (n > 0).astype(np.int64) << (2 + k)
        other = other - n
    shape |= np.minimum(other, 2) << 6  # none, one, or more symbols
    s = mix(shape.astype(np.uint64) + np.uint64(1 << 32))
    found = [(doc, h), (doc, s)]
    step = np.uint64(0x9E3779B97F4A7C15)
    if len(h) > 1:
        near = doc[1:] == doc[:-1]
        same = (h[1:] == h[:-1]).astype(np.uint64)
        found += [(doc[1:][near], mix(h[:-1] * step + h[1:])[near]), (doc[1:][near], mix(s[:-1] * step + s[1:] + same)[near])]
    if len(h) > 2:
        near = doc[2:] == doc[:-2]
        found.append((doc[2:][near], mix((s[:-2] * step + s[1:-1]) * step + s[2:])[near]))
    # how much of a text a shape, or a repeated neighbour, takes, in eighths; and the number of words, in powers of two
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))) if len(h) else np.zeros(0, bool)
    part, count = np.unique(np.concatenate([doc * 512 + shape, doc[again] * 512 + 511]), return_counts=True)
    eighths = (8 * count) // np.maximum(per[part // 512], 1)
    found.append((part // 512, mix(((part % 512) * 16 + eighths).astype(np.uint64) + np.uint64(2 << 32))))
    found.append((np.arange(n_docs), mix(np.log2(per + 1.0).astype(np.uint64) + np.uint64(3 << 32))))
    d = np.concatenate([x for x, _ in found]).astype(np.uint64)
    f = np.concatenate([x for _, x in found]) % np.uint64(DIMENSIONS)
    both = np.unique(d * np.uint64(DIMENSIONS) + f)
    return (both // np.uint64(DIMENSIONS)).astype(np.int64), (both % np.uint64(DIMENSIONS)).astype(np.int64)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in text_blocks(batches):
        doc, f = cells(buf, offs)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        f = f.astype("<u4")
        yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array([f[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["label", "cells"])


def fit(labels: np.ndarray, docs: list[np.ndarray], epochs: int = EPOCHS, penalty: float = PENALTY) -> tuple[np.ndarray, float, float]:
    """Weight of each cell times its ratio, the bias, and the logistic curve's scale; the ratio itself is row 1 of the weights."""
    weights = np.zeros((2, DIMENSIONS), np.float32)
    if not len(labels) or labels.min() == labels.max():
        return weights, (0.0 if not len(labels) else np.log(3) * (1 if labels[0] else -1)), 1.0
    counts = np.ones((2, DIMENSIONS))
    for y, x in zip(labels, docs):
        counts[int(y), x] += 1
    share = counts / counts.sum(1, keepdims=True)
    r = np.log(share[1] / share[0])
    rows = [r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum() + 1)) for x in docs]
    y = np.where(labels > 0, 1.0, -1.0)
    # the rarer class weighs as much as the other; the bias is a cell that every document has
    most = penalty * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, b, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    diagonal = np.array([(x * x).sum() + 1 for x in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = docs[i], rows[i]
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    weights[0], weights[1] = w * r, r
    margins = np.array([w[x] @ v + b for x, v in zip(docs, rows)])
    return weights, float(b), float(3.0 / max(1e-6, np.median(np.abs(margins))))


def score_block(buf: np.ndarray, offs: np.ndarray, model: tuple[np.ndarray, float, float]) -> np.ndarray:
    weights, bias, scale = model
    doc, f = cells(buf, offs)
    n = len(offs) - 1
    norm = np.sqrt(np.bincount(doc, weights[1][f].astype(float) ** 2, n) + 1)
    margin = np.bincount(doc, weights[0][f].astype(float), n) / norm + bias
    return 1 / (1 + np.exp(-np.clip(scale * margin, -30, 30)))


def may_learn(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """A model from `labels` (doc_id, label), at most `sample` rows of it."""
    chosen = labels.filter("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int"), "text", "doc_id")
    got = sorted((r["label"], bytes(r["cells"])) for r in rows.select("label", "text").mapInArrow(features, "label int, cells binary").collect())
    return fit(np.array([y for y, _ in got]), [np.frombuffer(x, "<u4").astype(np.int32) for _, x in got])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches):
            p = score_block(buf, offs, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text", (~may_learn()).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels.filter(may_learn()).select("doc_id", F.col("quality").alias("label"))))
