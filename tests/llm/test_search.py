import brute
import pytest

from isoweave.llm import decontaminate as D
from isoweave.llm import jaccard_join as J
from isoweave.llm import substring_dedup as U
from isoweave.llm import suffix_dedup as S
from isoweave.llm import windows as W
import hashlib
from collections import Counter
import re
from conftest import frame, some_texts


@pytest.fixture(scope="module")
def items(texts):
    w = [brute.words(t) for t in texts.values() if t and len(t) > 300]
    return [(1, " ".join(w[3][5:30])), (2, " ".join(w[3][20:40])), (3, " ".join(w[5][:5])), (4, None), (5, "..."), (6, "no such words here at all in any of the texts"), (7, " ".join(w[8][2:10]).upper()), (3, " ".join(w[5][:5])), (10, "one two")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs, texts, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.contamination(docs, bench, block=block).collect()}
    assert got == brute.contamination(texts, items)
    assert any(x[4] for x in got.values())


def test_removal(spark, docs, texts, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(texts, items)
    out = D.remove_contaminated(docs, bench)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert set(left) == {i for i, x in want.items() if not x[4]}
    for i, r in left.items():
        if want[i][1] == 0:
            assert r["text"] == texts[i]
        else:
            assert len(brute.ALNUM.findall(brute.lower(r["text"]))) == want[i][0] - want[i][1] and r["n_chars"] == len(r["text"])
    assert D.remove_contaminated(empty, bench).count() == 0
    assert D.remove_contaminated(docs, bench.filter("false")).count() == len(texts)


@pytest.mark.parametrize("block", [1, 40])
def test_removal_of_several_blocks(spark, docs, texts, items, block):
    # overlapping windows of two items, and one item each of two blocks, in documents of their own
    w = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(w[:10]), 0), (2, "a b " + " ".join(w[:9]) + " c", 0), (3, " ".join(w[20:29]) + " and " + " ".join(w[:9]), 0), (4, "x " + " ".join(w[4:16]), 0), (5, None, 0)]
    few = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, " ".join(w[:9])), (2, " ".join(w[20:29])), (3, " ".join(w[4:12])), (4, " ".join(w[6:16]))], "item_id long, text string")
    for d, b in ((docs, spark.createDataFrame(items, "item_id long, text string")), (few, bench), (few, bench.filter("item_id <> 3"))):
        for least in (2, 9):
            rows_of = lambda size: sorted(map(tuple, D.remove_contaminated(d, b, min_items=least, block=size).collect()), key=repr)
            assert rows_of(block) == rows_of(D.BLOCK)
    left = {r["doc_id"]: r["text"] for r in D.remove_contaminated(few, bench.filter("item_id < 3"), block=block).collect()}
    assert set(left) == {1, 2, 4, 5} and left[2] == "a b  c" and left[5] is None
    assert {r["doc_id"]: r["text"] for r in D.remove_contaminated(few, bench.filter("item_id > 2"), min_items=9, block=block).collect()}[4] == "x "


@pytest.mark.parametrize("seed,family", [(0, J.FAMILY), (1, 150), (2, 40)])
def test_jaccard(spark, scratch, seed, family):
    texts = some_texts(seed)
    # a family whose members are near each other only along a chain, and one of near copies of one text
    base = [f"w{k}" for k in range(60)]
    for k in range(12):
        texts[1000 + k] = " ".join(base[: 20 + 4 * k])
    for k in range(25):
        texts[2000 - k] = " ".join(base[:k] + [f"x{seed}{k}"] + base[k:])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(frame(spark, texts), scratch, family=family).collect()}
    assert got == brute.components(texts)


def test_jaccard_edges(spark, docs, texts, empty, scratch):
    assert J.near_duplicates(empty, scratch).count() == 0
    assert J.near_duplicates(docs.filter("doc_id = 0"), scratch).first()["component_id"] == 0
    kept = {r["doc_id"] for r in J.first_of_each(docs, scratch).collect()}
    assert kept == {i for i, (_, c) in brute.components(texts).items() if c == i}


def test_prefixes_find_all_links():
    """The bound itself: of linked sets, prefixes share min(L, L) shingles."""
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(2, 200))
        x = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        y = x.copy()
        r.shuffle(y)
        y = np.unique(np.concatenate([y[: len(y) - int(r.integers(0, max(1, len(y) // 9) + 1))], r.integers(0, 1 << 60, int(r.integers(0, max(1, n // 9) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (m1, p1), (m2, p2) = (J.prefix_of(s, r.random(len(s)) * 50 + 1) for s in (x, y))
            assert len(np.intersect1d(x[:p1], y[:p2])) >= min(m1, m2)


@pytest.mark.parametrize("batch", [W.BATCH_WINDOWS, 20])
def test_suffix_dedup(docs, texts, scratch, batch):
    units = {i: (t or "").encode() for i, t in texts.items()}
    gone = brute.repeated(units, S.WIDTH)
    for r in S.dedup_bytes(docs, scratch, with_text=True, batch=batch).collect():
        g = gone[r["doc_id"]]
        kept = bytes(b for b, x in zip(units[r["doc_id"]], g) if not x)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(g), sum(g), len(re.findall(b"\1+", bytes(g))))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["kept"] == kept
    assert any(map(any, gone.values()))


@pytest.mark.parametrize("batch", [W.BATCH_WINDOWS, 5])
def test_substring_dedup(docs, texts, scratch, batch):
    units = {i: brute.words(t) for i, t in texts.items()}
    gone = brute.repeated(units, U.WIDTH)
    for r in U.dedup_words(docs, scratch, with_text=True, batch=batch).collect():
        g = gone[r["doc_id"]]
        kept = " ".join(w for w, x in zip(units[r["doc_id"]], g) if not x)
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(g), sum(g), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert any(map(any, gone.values()))


def test_dedup_of_nothing(empty, scratch):
    assert S.dedup_bytes(empty, scratch).count() == 0 and U.dedup_words(empty, scratch).count() == 0


def test_periodic_text(spark, scratch):
    """Windows that repeat within one document, overlapping themselves."""
    texts = {1: "ab" * 400, 2: "x" * 199, 3: "y" * 200, 4: "z" * 201, 5: "w " * 36, 6: "v " * 35}
    d = frame(spark, texts)
    units = {i: t.encode() for i, t in texts.items()}
    assert {r["doc_id"]: r["n_removed"] for r in S.dedup_bytes(d, scratch).collect()} == {i: sum(g) for i, g in brute.repeated(units, 200).items()}
    units = {i: brute.words(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_removed"] for r in U.dedup_words(d, scratch).collect()} == {i: sum(g) for i, g in brute.repeated(units, 35).items()}


def test_repeated_rows(spark, scratch):
    """A row that stands twice: a row each, as copies of each other for the deduplicating operators."""
    long, other = " ".join(f"w{k}" for k in range(90)), " ".join(f"v{k}" for k in range(80))
    d = frame(spark, {1: long, 2: other}).union(frame(spark, {1: long}))
    assert sorted((r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in S.dedup_bytes(d, scratch).collect()) == [(1, True), (1, True), (2, False)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in U.dedup_words(d, scratch).collect()) == [(1, 90), (1, 90), (2, 0)]
    assert sorted((r["doc_id"], r["component_id"]) for r in J.near_duplicates(d, scratch).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_hot_anchor(spark, scratch):
    """A passage that many documents share, each with words of its own around it: many strings of one anchor."""
    passage = " ".join(f"p{k}" for k in range(45))
    texts = {i: " ".join(f"a{i}x{k}" for k in range(40)) + " " + passage + " " + " ".join(f"b{i}x{k}" for k in range(40)) for i in range(30)}
    texts[50] = "the " * 300
    d = frame(spark, texts)
    units = {i: brute.words(t) for i, t in texts.items()}
    want = {i: sum(g) for i, g in brute.repeated(units, 35).items()}
    assert {r["doc_id"]: r["n_removed"] for r in U.dedup_words(d, scratch, batch=3).collect()} == want
    units = {i: t.encode() for i, t in texts.items()}
    want = {i: sum(g) for i, g in brute.repeated(units, 200).items()}
    assert {r["doc_id"]: r["n_removed"] for r in S.dedup_bytes(d, scratch, batch=30).collect()} == want


def test_suffix_order():
    """The suffixes' order is that of their bytes, and only those of equal bytes count, whatever their hashes."""
    import numpy as np

    r = np.random.default_rng(1)
    buf = r.integers(97, 99, 900).astype(np.uint8)
    buf[300:600] = buf[:300]
    at, group = np.arange(0, 900 - 40), r.integers(0, 3, 860)
    order, equal = S.sorted_suffixes(buf, at, group, 40)
    key = lambda i: (group[i], buf[at[i] : at[i] + 40].tobytes())
    assert order.tolist() == sorted(range(860), key=lambda i: (*key(i), i))
    assert equal.tolist() == [bool(k) and key(order[k]) == key(order[k - 1]) for k in range(860)]
    # a Thue-Morse string and its complement have the same polynomial hash whatever the base
    tm = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = bytes(97 + x for x in tm), bytes(98 - x for x in tm)
    assert S.byte_hashes([a, b], np.array([1, 1]), 2048)[0] == S.byte_hashes([a, b], np.array([1, 1]), 2048)[1]
    assert not S.marked_bytes([a, b], np.array([1, 1]), np.array([0, 0]), None, 2048).any()
    assert S.marked_bytes([a, a], np.array([1, 1]), np.array([0, 0]), None, 2048).all()


def test_word_hashes_of_crafted_words():
    import numpy as np

    from isoweave.llm.common import SPACED, word_hashes, words

    tm = [bin(k).count("1") % 2 for k in range(2048)]
    text = b" ".join([bytes(97 + x for x in tm), bytes(98 - x for x in tm), b"a", b"aa", b"a" * 8, b"a" * 9, b"a" * 300, b"a" * 301, b"a" * 300])
    buf = np.frombuffer(text, np.uint8)
    start, end, _ = words(buf, np.array([0, len(buf)]), SPACED)
    h = word_hashes(buf, start, end)
    assert len(np.unique(h)) == 8 and h[6] == h[8]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_of_repeated_rows(spark, block):
    """Rows that stand twice, one id with two texts, null ids of documents and items: a row each, whatever the blocks."""
    w = [f"w{k}" for k in range(30)]
    text, other = "a " + " ".join(w[:9]) + " b " + " ".join(w[20:29]), "c " + " ".join(w[2:12])
    rows = [(1, text, "x"), (1, text, "x"), (1, other, "y"), (None, other, "z"), (2, None, "n"), (2, None, "n"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(5, " ".join(w[:9])), (5, " ".join(w[:9])), (6, " ".join(w[20:29])), (None, " ".join(w[2:12])), (7, None)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in D.contamination(docs, bench, block=block).collect())
    assert got == [("1", 11, 0, 0, False), ("1", 20, 18, 2, True), ("1", 20, 18, 2, True), ("2", 0, 0, 0, False), ("2", 0, 0, 0, False), ("3", 0, 0, 0, False), ("None", 11, 0, 0, False)]
    left = sorted(map(str, D.remove_contaminated(docs, bench, block=block).collect()))
    assert left == sorted(str(r) for r in docs.collect() if r["text"] != text)


def test_decontamination_of_a_long_text(spark):
    """A text of 200,000 words that holds one window many times, and items that share it."""
    window = " ".join(f"w{k}" for k in range(8))
    text = " ".join(f"{window} x{k}" for k in range(22_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"y{k} {window} z{k}") for k in range(30)], "item_id long, text string")
    r = D.contamination(docs, bench).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (198_000, 176_000, 30)


def test_dedup_of_long_texts(spark, scratch):
    """Texts of 200,000 words, one of them with a changed word in the middle."""
    w = [f"v{k}" for k in range(200_000)]
    texts = {1: " ".join(w), 2: " ".join(w[:100_000] + ["changed"] + w[100_001:]), 3: " ".join(w[:1000])}
    d = frame(spark, texts)
    assert {r["doc_id"]: r["component_id"] for r in J.near_duplicates(d, scratch).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_removed"] for r in U.dedup_words(d, scratch).collect()} == {1: 199_999, 2: 199_999, 3: 1000}
    n = {i: len(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_removed"] for r in S.dedup_bytes(d, scratch).collect()} == {1: n[1] - len("v100000"), 2: n[2] - len("changed"), 3: n[3]}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_split_by_ids(spark, n):
    from isoweave.llm.common import split_by_ids

    ids = spark.createDataFrame([(i * 7 - 300,) for i in range(n)] + [(None,)] * (n > 0), "doc_id long")
    rows = [(i, str(i), i) for i in range(-500, 3000)] + [(None, "x", 0), (None, "y", 1), (7, "again", 2), (7, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, word string, bits int")
    maybe, others = split_by_ids(docs, ids)
    assert maybe.columns == others.columns == docs.columns
    a, b = ([tuple(r) for r in x.collect()] for x in (maybe, others))
    assert Counter(a + b) == Counter(rows)
    have = {r["doc_id"] for r in ids.collect()}
    assert not [r for r in b if r[0] in have]
    assert len([r for r in a if r[0] not in have]) < len(rows) / 20


def test_whole_texts_reach_python_in_short_batches(spark, scratch):
    import pyarrow as pa
    from isoweave.llm import common

    docs, before = spark.range(0, 5000, 1, 1), spark.conf.get(common.ROWS_CONF)
    sizes = lambda batches: (b.select(["id"]).slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in batches)
    out = scratch.cut(docs.mapInArrow(common.lean(sizes), "id long"), texts=True)
    got = [r.id for r in out.collect()]
    assert sum(got) == 5000 and max(got) <= common.TEXT_ROWS and spark.conf.get(common.ROWS_CONF) == before


@pytest.mark.parametrize("dedup", [U.dedup_words, S.dedup_bytes])
def test_dedup_reads_texts_in_short_batches(spark, docs, scratch, monkeypatch, dedup):
    from isoweave.llm import common

    rows = []
    monkeypatch.setattr(common, "short_batches", lambda spark: rows.append(1) or common.nullcontext())
    assert dedup(docs, scratch).count() == docs.count()
    assert len(rows) == 3  # marking, packing, cutting
