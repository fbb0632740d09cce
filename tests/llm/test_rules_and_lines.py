import math

import brute
import pytest
import xxhash

from isoweave.llm import line_dedup as L
from isoweave.llm import quality_rules as R


@pytest.fixture(scope="module")
def trusted(spark):
    return spark.createDataFrame([("one two three a, The",), ("a b c",), (None,)], "text string")


def test_base_counts(docs, texts, trusted):
    got = {r["doc_id"]: r for r in R.quality_scores(docs.select("doc_id", "text"), trusted).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = brute.base_counts(t)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])


def grams(text, buckets):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in brute.words(text)]
    return [x & (buckets - 1) for x in h] + [((a >> 20) ^ b) & (buckets - 1) for a, b in zip(h, h[1:])]


def test_scores_against_plain_version(docs, texts, trusted):
    buckets = 1 << 8
    r, t = [1] * buckets, [1] * buckets
    for x in texts.values():
        for b in grams(x, buckets):
            r[b] += 1
    for x in ("one two three a, The", "a b c"):
        for b in grams(x, buckets):
            t[b] += 1
    ratio = [math.log(b / sum(t)) - math.log(a / sum(r)) for a, b in zip(r, t)]
    for row in R.quality_scores(docs.select("doc_id", "text"), trusted, buckets=buckets, threshold=-0.2).collect():
        g = grams(texts[row["doc_id"]], buckets)
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(row["score"] - want) < 1e-9
        if abs(want + 0.2) > 1e-9:
            assert row["kept"] == (not row["base_failed"] and want >= -0.2)


def test_filter_keeps_columns(docs, empty, trusted):
    out = R.quality_filter(docs, trusted, threshold=-50.0)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert R.quality_filter(empty, trusted).count() == 0


def test_no_trusted_texts(docs, trusted):
    rows = R.quality_scores(docs.select("doc_id", "text"), trusted.filter("false")).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows)


def plain_dedup(texts, window=L.WINDOW, divisor=L.DIVISOR):
    """Chunks by the same rule; equal ones of two lines or more go, but for the first."""
    h = lambda s, seed=42: xxhash.xxh64(s.encode(), seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seen, out = set(), {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = None
            continue
        lines, chunks, begin = texts[i].split("\n"), [], 0
        for k, line in enumerate(lines):
            x = 42
            for j in range(window):
                if k - j >= 0:
                    x = h(lines[k - j], x)
            if signed(x) % divisor == 0 or k == len(lines) - 1:
                chunks.append(lines[begin : k + 1])
                begin = k + 1
        kept = []
        for c in chunks:
            text = "\n".join(c)
            if len(c) > 1 and brute.words(text):
                if text in seen:
                    continue
                seen.add(text)
            kept += c
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(docs, texts, scratch):
    out = L.dedup_lines(docs, scratch)
    assert out.columns[: len(docs.columns)] == docs.columns
    want = plain_dedup(texts)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(r["_n_removed"] for r in got.values()) == sum(t.count("\n") + 1 - (want[i].count("\n") + 1 if want[i] or t == "" else 0) for i, t in texts.items() if t is not None)
    assert any(r["_n_removed"] for r in got.values())


def least_two(texts, window=2, divisor=3):
    """As plain_dedup, but a chunk ends only where it has two lines."""
    h = lambda s, seed=42: xxhash.xxh64(s.encode(), seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seen, out = set(), {}
    for i in sorted(texts):
        lines, begin, kept = (texts[i] or "").split("\n"), 0, []
        for k, line in enumerate(lines):
            x = 42
            for j in range(min(window, k + 1)):
                x = h(lines[k - j], x)
            if signed(x) % divisor == 0 and k > begin or k == len(lines) - 1:
                c, begin = lines[begin : k + 1], k + 1
                text = "\n".join(c)
                if len(c) > 1 and brute.words(text):
                    if text in seen:
                        continue
                    seen.add(text)
                kept += c
        out[i] = None if texts[i] is None else "\n".join(kept)
    return out


def test_chunks_have_two_lines(spark, docs, texts, scratch, tmp_path):
    want = least_two(texts)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs, scratch, least=2).collect()} == want
    # a whole copy keeps one line at most, which the query must find as well
    copy = "\n".join(f"line {k} of a copy" for k in range(40))
    spark.createDataFrame([(1, copy), (2, copy)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] >= 39 for r in L.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: False, 2: True}


def test_line_dedup_of_nothing(empty, scratch):
    assert L.dedup_lines(empty, scratch).count() == 0


def test_line_dedup_of_repeated_rows_and_clashing_names(spark, scratch):
    """Rows that stand twice, null ids, and columns named as the operator's own."""
    copy = "\n".join(f"line {k} of a copy" for k in range(40))
    schema = "_lines string, doc_id long, text string, _gone int, _kept string, _id long, _n_removed int, hash string"
    rows = [("own", i, t, 1, "k", 9, 5, "h") for i, t in ((2, copy), (2, copy), (1, copy), (1, copy), (3, None), (3, None), (None, "x\ny"), (4, copy), (4, "a\n" + copy + "\nb"), (5, ""))]
    out = L.dedup_lines(spark.createDataFrame(rows, schema), scratch, least=2)
    assert out.columns[:8] == ["_lines", "doc_id", "text", "_gone", "_kept", "_id", "_n_removed", "hash"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and {(r[0], *r[3:8]) for r in got} == {("own", 1, "k", 9, 5, "h")}
    texts = {i: [r[2] for r in got if r[1] == i] for i in (1, 2, 3, 4, 5, None)}
    assert texts[1] == [copy, copy] and texts[3] == [None, None] and texts[5] == [""] and texts[None] == ["x\ny"]
    assert len(texts[2]) == 2 and texts[2][0] == texts[2][1] and len(texts[2][0]) < 40
    assert sorted(map(len, texts[4]))[0] < 40


def test_long_text_that_repeats(spark):
    """A text said twice: the work must not grow with its square."""
    import time

    half = " ".join(f"w{k}" for k in range(60_000))
    rows = spark.createDataFrame([(1, half + " " + half), (2, half)], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in R.quality_scores(rows, rows.limit(1)).collect()}
    assert got == {1: (120_000, 120_000, True), 2: (60_000, 0, False)}
    assert time.time() - start < 60


def test_rules_of_repeated_rows(spark, trusted):
    rows = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"]) for r in R.quality_scores(rows, trusted).collect())
    assert got == [("1", 12, False), ("1", 12, False), ("2", 0, True), ("None", 2, True)]
