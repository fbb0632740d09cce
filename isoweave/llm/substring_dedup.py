"""Substring dedup: every word that a 35-word window covers which also starts elsewhere in the corpus goes.

Super-k-mer partitioning: the minimiser of a window is the least hash among its runs of `GRAM` words; consecutive
windows that share one travel as a single packed string to its bucket (see windows.py; strings whose minimiser
occurs once in the corpus have no need to travel), and there sorting the windows counts them. Windows whose
hashes agree are compared as bytes before they count.

Defined cases: null and empty texts have no words. Texts under 35 words lose nothing, copies or not. doc_id is a
key; repeated rows are copies of each other and give a row each. Overlapping windows count, within a document as well; judged on the input, so that all occurrences go, the
first too. Words are runs of other than space and bytes 9-13, unchanged. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Scratch, equal_spans, gram_hashes, lean, mix, padded, table, text_blocks, word_hashes, words
from .suffix_dedup import removed
from .windows import BATCH_WINDOWS, Kind, with_ranges

WIDTH, GRAM = 35, 5


def word_grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(buf, offs, SPACED)
    return gram_hashes(word_hashes(buf, start, end), GRAM), first


def packer(text: bytes) -> Callable[[int, int], bytes]:
    buf = np.frombuffer(text, np.uint8)
    start, end, _ = words(buf, np.array([0, len(buf)]), SPACED)
    return lambda a, b: b" ".join(text[i:j] for i, j in zip(start[a:b].tolist(), end[a:b].tolist()))


def bounds(strings: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings one after the other, with the starts, ends and hashes of their words, and the first word of each string."""
    flat = b"".join(strings)
    buf = np.frombuffer(flat, np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    start, end, first = words(buf, offs, SPACED)
    return flat, start, end, word_hashes(buf, start, end), first


def window_words(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first word of each window."""
    string = np.repeat(np.arange(len(n)), n)
    return first[:-1][string] + np.arange(len(string)) - (np.cumsum(n) - n)[string]


def marked_words(strings: list[bytes], n: np.ndarray, group: np.ndarray, only: np.ndarray | None = None, width: int = WIDTH) -> np.ndarray:
    """Flags of the windows (those of `only` alone, if given) that occur again in a string of the same group, or again in their own."""
    flat, start, end, h, first = bounds(strings)
    at, group = window_words(n, first), np.repeat(group, n)
    buf, flags = padded(np.frombuffer(flat, np.uint8)), np.zeros(len(at), bool)
    if only is not None:
        at, group = at[only], group[only]
    key = gram_hashes(h, width)[at] ^ mix(group.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    pair = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    got = np.zeros(len(at), bool)
    for i in range(0, len(pair), 1 << 18):
        p = pair[i : i + (1 << 18)]
        p = p[group[order[p]] == group[order[p + 1]]]
        x, y = at[order[p]], at[order[p + 1]]
        n_x, n_y = end[x + width - 1] - start[x], end[y + width - 1] - start[y]
        p = p[(n_x == n_y) & equal_spans(buf, start[x], buf, start[y], np.minimum(n_x, n_y))]
        got[order[p]] = got[order[p + 1]] = True
    if only is None:
        return got
    flags[only] = got
    return flags


def word_window_hashes(strings: list[bytes], n: np.ndarray, width: int = WIDTH) -> np.ndarray:
    _, _, _, h, first = bounds(strings)
    return gram_hashes(h, width)[window_words(n, first)]


def word_part(string: bytes, width: int = WIDTH) -> Callable[[int, int], bytes]:
    cut = packer(string)
    return lambda a, b: cut(a, b - 1 + width)


WORDS = Kind(WIDTH, word_grams, GRAM, packer, marked_words, word_window_hashes, word_part)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def cut_words(with_text: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches):
            start, end, first = words(buf, offs, SPACED)
            flat, out = buf.tobytes(), []
            for d, (doc, a, b, copy) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "_a", "_b", "_copy")))):
                i, j = first[d], first[d + 1]
                gone = removed(copy, int(j - i), a, b, WIDTH)
                kept = b" ".join(flat[x:y] for x, y in zip(start[i:j][~gone].tolist(), end[i:j][~gone].tolist()))
                out.append((doc, int(j - i), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_words(docs: DataFrame, scratch: Scratch, with_text: bool = False, batch: int = BATCH_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and kept (the words left; null unless `with_text`)."""
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    out = with_ranges(plain, WORDS, scratch, batch).mapInArrow(lean(cut_words(with_text)), OUT)
    return out if with_text else scratch.cut(out, texts=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"), Scratch(spark, "op9")).drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM w)),
dup AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win JOIN dup USING (t)),
n AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
