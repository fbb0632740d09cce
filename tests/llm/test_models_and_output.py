import collections
import html
import re
import zlib

import numpy as np
import pytest

from isoweave.llm import html_extract as H
from isoweave.llm import packing as P
from isoweave.llm import quality_model as M
from isoweave.llm import token_store as T
from isoweave.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in M.op1_quality_classifier(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    assert len(got) == table(spark, d, "documents").count()
    held = [i for i in labels if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    good = [got[i]["score"] for i in held if labels[i] == 1]
    bad = [got[i]["score"] for i in held if labels[i] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in M.score(docs, M.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(10, 1), (12, 1), (13, None)], "doc_id long, label int")
    assert all(abs(r["score"] - 0.75) < 1e-9 for r in M.score(docs, M.train(docs, one)).collect())
    assert M.score(empty, M.train(empty, none)).count() == 0


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script>{head}</head><body>{body}</body></html>"


def test_extraction_rules():
    text = lambda p: H.article_text(p, {})
    assert text("") == "" and text("plain <b>text</b>  here") == "plain text here"
    full = page('<header>Top</header><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><aside>Side</aside><div id="cookie-notice">Ok?</div><article><h1>A &amp; B</h1><p>One<br>two &#8212;\n\t three<p><b>Four</b></p><div class="comments"><p>Nice!</p></div><form>Mail</form></article><footer>&copy; x</footer>')
    assert text(full) == "A & B\nOne two — three\nFour"
    assert text(page("<div class='content'><p>Only this</p></div><div class='sidebar'>no</div>")) == "Only this"
    assert text("<article><p>cut off in <b>the mid") == "cut off in the mid"
    assert text("<article><p>x</p><p>y</p><!-- <p>no</p> --><p>a < b & c &lt; d</p></article>") == "x\ny\na < b & c < d"


def test_wrapper_inference():
    rows = [page(f"<div><h1>Title {k}</h1>" + "".join(f"<p>Text {k} {j}</p>" for j in range(k + 1)) + "<p class='line'>Written by our staff</p></div>") for k in range(4)]
    template = H.infer(rows)
    assert any("Written by our staff" in t for t in template.values())
    assert H.article_text(rows[2], template) == "Title 2\nText 2 0\nText 2 1\nText 2 2"
    assert H.infer(rows[:1] * 5) == {} and H.infer([]) == {} and H.infer(rows[:1]) == {}


def test_extraction_of_all_pages(spark, data, scratch):
    pages = table(spark, data, "pages")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    out = H.extract_pages(pages.withColumn("template", pages["url"]).withColumn("host", pages["url"]), scratch).collect()
    assert len(out) == len(raw)
    for r in out:
        m = re.search(r"<article>(.*?)(</article>|\Z)", raw[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", m))
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_copies_are_no_template():
    copies = [page(f"<div class='ad'>Ad {k}</div><div><h1>Title</h1><p>One</p><p>Two</p><h2>More</h2></div>") for k in range(5)]
    assert H.infer(copies) == {}
    long = [page("<div>" + "".join(f"<h2>H {k} {j}</h2>" + "<p>a</p>" * (1 + j % 2) for j in range(2500)) + f"<h3>Last {k}</h3><h4>All rights reserved</h4></div>") for k in range(3)]
    assert "All rights reserved" in sum(H.infer(long).values(), [])


def test_template_is_confirmed_over_all_pages(spark, scratch):
    # a marked article keeps its constant texts
    rows = [(k, "http://a/", page(f"<article><h1>Same</h1><p>Text {k}</p></article>")) for k in range(6)]
    # a host whose copies of one page outnumber the others
    rows += [(100 + k, "http://b/", page("<div><h1>Copy</h1><p>One</p><p>Two</p></div>")) for k in range(40)] + [(200, "http://b/", page("<div><h1>Other</h1><p>Three</p></div>"))]
    # a text of half of the pages, those that the sample takes, and one of all pages
    body = lambda k, own: page(f"<div><h1>Title {k}</h1><p>Text {k}</p><h2>{own}</h2><h3>All</h3></div>")
    made = [(k, *x) for k in range(240) for x in (("Half", body(k, "Half")), (f"Own {k}", body(k, f"Own {k}")))]
    made = spark.createDataFrame(made, "k int, own string, html string").selectExpr("*", "xxhash64(html) AS h").orderBy("h").collect()
    half = [r for r in made if r["own"] == "Half"][:60]
    own = [r for r in made if r["own"] != "Half" and r["h"] > half[7]["h"] and r["k"] not in {x["k"] for x in half}][:60]
    rows += [(300 + r["k"], "http://c/", r["html"]) for r in half + own]
    out = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert all(out[k] == f"Same\nText {k}" for k in range(6))
    assert all(out[100 + k] == "Copy\nOne\nTwo" for k in range(40)) and out[200] == "Other\nThree"
    assert len(own) == 60 and all(out[300 + r["k"]] == f"Title {r['k']}\nText {r['k']}\n{r['own']}" for r in half + own)


def test_extraction_of_nothing(spark, scratch):
    rows = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://h/", "<p>a</p>"), (3, "http://h/", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in H.extract_pages(rows, scratch).collect()) == [(1, ""), (2, ""), (3, "a"), (3, "a")]
    assert H.extract_pages(rows.filter("false"), scratch).count() == 0


def test_token_store(spark, docs, texts, scratch):
    path = scratch.path()
    T.write_store(docs, path, PATH)
    tok = tokenizers.Tokenizer.from_file(PATH)
    got = {r["doc_id"]: tuple(r) for r in T.read_store(spark, path, 2, T.crc_rows(2), "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    start = 0
    for i in sorted(texts):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() and chunks.filter("n_refs > 1").count() > 0


def test_token_store_finds_damage(spark, docs, scratch):
    path = scratch.path()
    T.write_store(docs, path, PATH)
    read = lambda p: T.read_store(spark, p, 2, T.crc_rows(2), "doc_id long, start long, n_tokens long, ids_crc32 long")
    bad = scratch.path()
    first = bytes(spark.read.parquet(f"{path}/recipes").filter("doc_id = 20").first()["digests"][:20])
    c = spark.read.parquet(f"{path}/chunks")
    from pyspark.sql import functions as F

    c.withColumn("data", F.when(F.col("digest") == F.lit(first), F.lit(b"\0\0")).otherwise(F.col("data"))).write.parquet(f"{bad}/chunks")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
    with pytest.raises(Exception, match="chunks don't give"):
        read(bad).collect()
    worse = scratch.path()
    c.write.parquet(f"{worse}/chunks")
    spark.read.parquet(f"{path}/recipes").filter("doc_id != 20").write.parquet(f"{worse}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{worse}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        read(worse)


def test_token_store_of_nothing(spark, empty, scratch):
    path = scratch.path()
    T.write_store(empty, path, PATH)
    assert T.read_store(spark, path, 2, T.crc_rows(2), "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_word_encoder():
    e, tok = T.WordEncoder(PATH), tokenizers.Tokenizer.from_file(PATH)
    odd = ["a\x1cb c d", "<|endoftext|> x <|startoftext|>", "é ́x", "", "  ", "Σας ΣΑΣ İ", "it's 12 3a4 don't,, ok?!", "x٠ ½"]
    ids, at = e.encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_packing(docs, texts, empty):
    rows = P.pack_documents(docs, shard=10).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece_at"], r["n_tokens"]))
    import brute

    for i, t in texts.items():
        n, at = len(brute.words(t)) + 1, 0
        for a, k in sorted(got[i]):
            assert a == at and 0 < k <= max(P.SIZES)
            at += k
        assert at == n
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["bin_id"], r["bin_size"]].append((r["bin_at"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), inside in bins.items():
        at = 0
        for a, k in sorted(inside):
            assert a == at
            at += k
        assert at <= size and size in P.SIZES and not any(at <= s < size for s in P.SIZES)
    assert P.pack_documents(empty).count() == 0


def test_packing_fills():
    lengths = sorted((int(x) for x in np.random.default_rng(3).lognormal(5.5, 1.0, 4000).clip(1, 4096)), reverse=True)
    bins, _, sizes = P.pack(lengths)
    assert len(bins) == len(lengths) and sum(lengths) / sum(sizes) > 0.97
    assert P.pack([]) == ([], [], [])


def test_token_store_of_repeated_rows(spark, scratch):
    """Rows that stand twice, ids that are null, and one id with two texts: each row comes back."""
    rows = [(2, "b c " * 700), (1, "a"), (1, "a"), (2, "b c " * 700), (None, "x y"), (3, None), (4, "p"), (4, "q r")]
    path = scratch.path()
    T.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH)
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]])
    got = T.read_store(spark, path, 2, T.crc_rows(2), "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    assert [r["doc_id"] or 0 for r in order] == sorted(r["doc_id"] or 0 for r in order)


def test_encoder_compares_bytes(monkeypatch):
    """Words whose hashes collide, by craft or by a poor hash, are encoded as they are."""
    tok = tokenizers.Tokenizer.from_file(PATH)
    tm = [bin(k).count("1") % 2 for k in range(1024)]
    texts = ["".join("ab"[x] for x in tm), "".join("ba"[x] for x in tm), "one two three", "two one. four three", "five <|endoftext|> one"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    ids, at = T.WordEncoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    monkeypatch.setattr(T, "word_hashes", lambda buf, a, b: (b - a).astype(np.uint64))
    ids, at = T.WordEncoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_other_tokenizers():
    """A file with other rules is taken at its word."""
    other = public.path("byte_bpe_50k.json")
    e, tok = T.WordEncoder(other), tokenizers.Tokenizer.from_file(other)
    texts = ["One two  THREE", "", "x\n y é", "<|endoftext|>"]
    ids, at = e.encode(texts)
    assert not e.by_words and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_merkle_roots():
    for n in range(20):
        leaves = [bytes([k]) * 20 for k in range(n)]
        tree = T.Merkle()
        for x in leaves:
            tree.add(x)
        assert tree.root() == T.merkle(leaves)


def plain_pack(lengths, sizes):
    """Best fit, step by step: the fullest open bin that still holds the piece, the newest of equals; else the cheapest new one."""
    cost = lambda c: c + 0.25 * c * c / max(sizes)
    price, bins, out = min(cost(c) / c for c in sizes), [], []
    for k, n in enumerate(lengths):
        rest = sum(lengths[k + 1 :])
        fits = [(size - used, -at, b) for b, (size, used, at) in enumerate(bins) if size - used >= n]
        if fits:
            b = min(fits)[2]
        else:
            options = sorted(c for c in sizes if c >= n)
            bins.append([min(options, key=lambda c: cost(c) - price * min(c - n, rest)), 0, 0])
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1:] = [bins[b][1] + n, k]  # touched last: the newest of those with equal room
    return out, [min(c for c in sizes if c >= used) for _, used, _ in bins]


@pytest.mark.parametrize("seed", range(8))
def test_packing_against_plain_version(seed):
    r = np.random.default_rng(seed)
    sizes = [(256, 512, 1024, 2048, 4096), (8, 16), (10,), (4, 6, 9, 30)][seed % 4]
    lengths = sorted((int(x) for x in r.integers(1, max(sizes) + 1, int(r.integers(1, 200)))), reverse=True)
    if seed > 3:
        lengths = sorted((int(x) for x in r.choice([1, 2, max(sizes) // 2, max(sizes)], 120)), reverse=True)
    bins, places, final = P.pack(lengths, sizes)
    assert (list(zip(bins, places)), final) == plain_pack(lengths, sizes)


def test_packing_of_repeated_rows_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, "w " * 9000)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in P.pack_documents(rows).collect())
    assert got == [("1", 0, 4), ("1", 0, 4), ("2", 0, 1), ("3", 0, 4096), ("3", 1, 4096), ("3", 2, 809), ("None", 0, 2)]


def test_classifier_fit_reaches_the_optimum():
    """The dual objective by coordinate descent against the primal one of the weights it gives: a small duality gap."""
    r = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(120):
        y = k % 2
        common = r.integers(0, 60, 12)
        own = r.integers(100 + 100 * y, 160 + 100 * y, 4)
        docs.append(np.unique(np.concatenate([common, own if k % 7 else common])).astype(np.int32))
        labels.append(y)
    labels = np.array(labels)
    weights, b, _ = M.fit(labels, docs, epochs=400)
    counts = np.ones((2, M.DIMENSIONS))
    for y, x in zip(labels, docs):
        counts[y, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(weights[1], ratio, atol=1e-5)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(np.abs(weights[1]) > 1e-12, weights[0] / weights[1], 0.0)
    rows = [ratio[x] / np.sqrt((ratio[x] ** 2).sum() + 1) for x in docs]
    y = np.where(labels > 0, 1.0, -1.0)
    most = M.PENALTY * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    primal = lambda w, b: 0.5 * ((w**2).sum() + b * b) + sum(m * max(0.0, 1 - t * (w[x] @ v + b)) for m, t, x, v in zip(most, y, docs, rows))
    # a plain subgradient descent over the same objective gets no lower
    u, c, best = np.zeros(M.DIMENSIONS), 0.0, np.inf
    for step in range(1, 1500):
        g, gc = u.copy(), c
        for m, t, x, v in zip(most, y, docs, rows):
            if t * (u[x] @ v + c) < 1:
                np.add.at(g, x, -m * t * v)
                gc -= m * t
        u, c = u - g / step, c - gc / step
        best = min(best, primal(u, c)) if step % 50 == 0 else best
    assert primal(w, b) <= best * 1.001


def test_classifier_cells():
    """Cells of a text are the same alone and in company, each once; those of words and pairs depend on these alone."""
    texts = [b"One two two 33", b"", b"two two", "caf\u00e9 ## One".encode()]
    one = lambda t: M.cells(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))[1].tolist()
    doc, f = M.cells(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
    assert [f[doc == d].tolist() for d in range(4)] == [one(t) for t in texts] and all(len(set(one(t))) == len(one(t)) for t in texts)
    assert set(one(b"two two")) != set(one(b"two")) and all(0 <= x < M.DIMENSIONS for x in f.tolist())


def unmarked(k, r, words):
    """A page of arbitrary class names without any marked part, and its main text."""
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    title, paras = say(5), [say(r.randint(15, 60)) for _ in range(r.randint(2, 7))]
    menu = "".join(f"<li><a href='/{j}'>{say(1)}</a></li>" for j in range(r.randint(3, 6)))
    body = f"<h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paras[:-1]) + f"<div class='q3'><p>{paras[-1]}</p></div>"
    html = f"<div class='x1'><ul class='x2'>{menu}</ul></div><div class='x9'>{say(6)}</div><div class='k0'><div class='k1'>{body}<p>Printed by the shop of this site</p></div></div><div class='x7'>Call us {say(2)}</div>"
    return page(html), "\n".join([title, *paras])


def test_wrappers_separate_pages_without_an_article(spark, scratch):
    """Nothing but the alignment of the host's pages tells its menu, its other slots and its fixed texts from the article."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows, want = [], {}
    for k in range(60):
        html, text = unmarked(k, r, words)
        rows.append((k, f"http://host{k % 3}.example/{k}", html))
        want[k] = text
    got = {x["page_id"]: x["text"] for x in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert got == want


def test_named_parts_of_an_article(spark, scratch):
    """Containers of an article that are named as something else stay, unless their text is the host's template."""
    body = lambda k, name: page(f"<article><h1>Same title</h1><p>Text {k}</p><section class='{name}'><p>Own {k}</p></section><div class='share'>Tell your friends</div><div class='comments'>Nice {k}</div></article>")
    names = ["legal", "tags", "related-work", "notice", "social"]
    rows = [(k, "http://a/", body(k, names[k % 5])) for k in range(20)]
    rows.append((50, "http://b/", body(7, "notice")))  # a host of one page: nothing is known to be fixed
    out = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert out == {k: f"Same title\nText {k}\nOwn {k}" for k in range(20)} | {50: "Same title\nText 7\nOwn 7\nTell your friends"}


def test_large_wrappers_are_dealt_by_host(spark, scratch, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST", 0)
    body = lambda k: page(f"<div><h1>Title {k}</h1><p>Text {k}</p><h3>All</h3></div>")
    rows = [(k, f"http://{'hot' if k % 3 else k}/", body(k)) for k in range(30)]
    out = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert out == {k: f"Title {k}\nText {k}" + ("" if k % 3 else "\nAll") for k in range(30)}


def test_hash_table_grows_with_what_it_holds():
    t = T.HashTable()
    assert t.keys.nbytes + t.values.nbytes <= 1 << 20  # an idle worker's table is no burden
    keys = np.random.default_rng(0).permutation(300_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for i in range(0, 200_000, 70_000):
        t.put(keys[i : min(i + 70_000, 200_000)], np.arange(i, min(i + 70_000, 200_000), dtype=np.int32))
    assert (t.get(keys[:200_000]) == np.arange(200_000)).all() and (t.get(keys[200_000:]) == -1).all()
    assert 400_000 <= len(t.keys) <= 1 << 20


def test_wrappers_come_from_all_pages_of_a_host(spark, scratch):
    """Menus, region and fixed texts that some pages lack, few of them or those first by hash: the other pages decide as well."""
    full = lambda k: page(f"<div class='a'><div class='c'><h2>Title {k}</h2><p>{'Long text ' * 20}{k}</p><h3>Printed here</h3></div><ul class='m'><li><a href='x'>One {k}</a></li><li><a href='y'>Two {k}</a></li></ul></div>")
    odd = lambda k: page(f"<div class='a'><div class='d'><h2>Odd title {k}</h2><p>Short {k}</p></div></div>")
    made = [(k, *x) for k in range(400) for x in (("full", full(k)), ("odd", odd(k)))]
    made = spark.createDataFrame(made, "k int, kind string, html string").selectExpr("*", "xxhash64(html) AS h").orderBy("h").collect()
    odds = [r for r in made if r["kind"] == "odd"][:8]
    rows = odds + [r for r in made if r["kind"] == "full" and r["h"] > odds[-1]["h"]][:120]
    table_ = spark.createDataFrame([(i, f"http://a/{i}", r["html"]) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.extract_pages(table_, scratch).collect()}
    for i, r in enumerate(rows):
        assert got[i] == (f"Odd title {r['k']}\nShort {r['k']}" if r["kind"] == "odd" else f"Title {r['k']}\n{'Long text ' * 20}{r['k']}")
    assert len(rows) == 128


def test_alignment_keeps_what_comes_out_of_order():
    rows = [page(f"<div><h1>T {k}</h1><h4>First</h4><p>Text {k}</p><h5>Last</h5></div>") for k in range(12)]
    template = H.infer(rows)
    assert H.article_text(rows[0], template) == "T 0\nText 0"
    assert H.article_text(page("<div><h5>Last</h5><p>Body</p><h4>First</h4></div>"), template) in ("Last\nBody", "Body\nFirst")
    assert H.rising([3, 0, 1, 4, 2, 5]) == [1, 2, 4, 5] and H.rising([]) == []
