import brute
import pytest
from conftest import frame

import corpus_pipeline
from isoweave.llm import decontaminate, packing, quality_rules
from test_rules_and_lines import plain_dedup


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(f"{top}/documents.parquet")
    w = brute.words(next(t for t in texts.values() if t and 500 < len(t) < 3000))
    items = [(1, " ".join(w[2:20])), (2, " ".join(w[10:30])), (3, "nothing like it anywhere in these texts at all")]
    # the texts' own words and pairs, but no window of eight of theirs, so that the quality rules know them
    for i, t in texts.items():
        items.append((100 + i, " ".join(f"zz{i}q{k}" if k % 7 == 6 else x for k, x in enumerate(brute.words(t)))))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    return str(top), items


def test_stages_against_plain_versions(spark, folder):
    top, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, top)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            kept = quality_rules.quality_scores(docs.select("doc_id", "text"), spark.createDataFrame(items, "i long, text string").select("text")).filter("kept")
            want = {r["doc_id"]: before[r["doc_id"]] for r in kept.collect()}
        elif name == "line_dedup":
            want = plain_dedup(before)
        elif name == "jaccard_join":
            want = {i: before[i] for i, (_, c) in brute.components(before).items() if c == i}
        elif name == "decontamination":
            found = brute.contamination(before, items)
            assert set(after) == {i for i, x in found.items() if not x[4]} and len(after) < len(before)
            want = {i: before[i] if not found[i][1] else after[i] for i in after}
            for i in after:
                assert len(brute.ALNUM.findall(brute.lower(after[i]))) == found[i][0] - found[i][1]
        else:
            total = sum(len(brute.words(t)) + 1 for t in before.values())
            assert sum(r["n_tokens"] for r in out.collect()) == total
            continue
        assert after == want, name
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows and max(r["bin_size"] for r in rows) <= max(packing.SIZES)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert decontaminate.N == 8


def test_first_and_last_stage_against_plain_versions(spark, folder):
    """The quality rules by Python's counts and logarithms, and the packing step by step."""
    import math

    from test_models_and_output import plain_pack
    from test_rules_and_lines import grams

    top, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = quality_rules.BUCKETS
    raw, trusted = [1] * n, [1] * n
    for counts, some in ((raw, texts.values()), (trusted, [t for _, t in items])):
        for t in some:
            for b in grams(t, n):
                counts[b] += 1
    ratio = [math.log(b / sum(trusted)) - math.log(a / sum(raw)) for a, b in zip(raw, trusted)]
    want = set()
    for i, t in texts.items():
        base, g = brute.base_counts(t), grams(t, n)
        failed = base["n_words"] < 10 or 100 * base["n_repeat_words"] > 20 * base["n_words"]
        if not failed and sum(ratio[b] for b in g) / len(g) >= quality_rules.THRESHOLD:
            want.add(i)
    out = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, top)
    assert {r["doc_id"] for r in out.collect()} == want and 0 < len(want) < len(texts)

    size, pieces = max(packing.SIZES), []
    for i, t in texts.items():
        words = len(brute.words(t)) + 1
        pieces += [(min(size, words - k * size), i, k) for k in range((words - 1) // size + 1)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    places, final = plain_pack([p[0] for p in pieces], packing.SIZES)
    want = {(i, k): (n_, b, at, final[b]) for (n_, i, k), (b, at) in zip(pieces, places)}
    rows = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, top).collect()
    assert {(r["doc_id"], r["piece"]): (r["n_tokens"], r["bin_id"], r["bin_at"], r["bin_size"]) for r in rows} == want
