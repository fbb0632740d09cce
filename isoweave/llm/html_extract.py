"""Main text of web pages by wrappers inferred per host: union-free regular expressions over token streams.

A page becomes a stream of tags (with class or id) and texts. Runs of equal neighbours collapse into repeated
groups (X)+. All different pages of a host make its wrapper, none stand for others:
* fixed texts: those outside repeated groups that stand, at one path, on at least `LEAST` different pages of the host
  and on `SHARE` of all its different pages of the same kind (with or without a marked article or main part);
* their order, by their mean place on these pages. Every page is aligned with it: the longest run of its fixed texts
  that comes in this order is the template's, what lies between are slots and groups;
* the region: the innermost element that holds `REGION_SHARE` of the text of all pages in slots and groups, whatever its
  name; what lies outside is not content;
* menus: paths that some page repeats and that have nothing but links in the slots of all pages.
On pages with a marked article the article is the region; all of it is content, but for template texts in containers
that are named as something else (notices, sharing, tags). What HTML itself says is no article (nav, header, footer,
aside, form, dialog, hidden, their roles), adverts and reader comments are left out everywhere. Only for hosts without
a wrapper do the names of containers decide.

Pages of equal content are one page, so copies prove nothing. Texts are counted by 128-bit hashes, in two readings of
all pages; what the hosts share one task for is a row for each path of a host.

Character references are decoded, white space within a block becomes one space, blocks are joined by newlines in
page order. Nothing else is dropped, whatever its length.

Defined cases: null html is empty text. A null or odd url counts as a host of its own name. A host of fewer than
`LEAST` different pages has no wrapper. A page with nothing in the host's region is taken whole. A text that a page has
several times at one path is told apart by its number. Pages that differ in content but share nine tenths of their
texts count as different. Repeated rows are extracted each. Extra columns are ignored. Pages cut off in the middle end
there: open elements close and an unfinished tag is dropped.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join, table

LEAST, SHARE, REGION_SHARE, BROADCAST = 3, 0.9, 0.75, 16 << 20
#: Keys of a host's wrapper beside paths; those of texts on marked pages begin with @.
ORDER, REGION, MENUS = "#order", "#region", "#menus"

# Fixed values of HTML.
RAW = "script|style|noscript|template|textarea|svg|iframe|select|title|math|object|canvas|audio|video"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_CONTENT = set("nav header footer aside form menu button dialog head fieldset label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget|footer|masthead|site-?header|page-?header|top-?bar"
    r"|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|tags|skip-?link|toolbar|legal|copyright)(?:$|[\s_-])",
    re.I,
)
#: Adverts and reader comments, which aren't the article's wherever they stand.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z", re.S | re.I)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    """A text of a page: path of open elements, text; whether it is in a marked article, left out by what HTML says, in
    a container named as something else, and all links."""

    path: str
    text: str
    article: bool
    left: bool
    named: bool
    link: bool


def blocks(page: str) -> list[Block]:
    """A page's texts in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, label, in article, left out, named
    held: list[str] = []
    plain = False  # whether text outside of links is held

    def flush() -> None:
        nonlocal plain
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            structure = [s for s in stack if s[0] in BLOCK]
            out.append(Block("/".join(s[1] for s in structure), text, *(stack[-1][2:] if stack else (False, False, False)), not plain))
        plain = False

    def hold(text: str) -> None:
        nonlocal plain
        held.append(text)
        plain = plain or not text.isspace() and all(s[0] != "a" for s in stack)

    def close(i: int) -> None:
        flush()
        del stack[i:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                held.append(" ") if m[1].lower() not in ("script", "style", "noscript", "template") else None
            continue
        if m[2]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if found is None:
                if name in BLOCK:
                    flush()
            elif name in BLOCK:
                close(found)
            elif not any(s[0] in BLOCK for s in stack[found:]):
                del stack[found:]
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in VOID or m[4].rstrip().endswith("/") and name not in BLOCK:
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m[4])} if m[4] else {}
        label = name + "".join(f".{x}" for x in attrs.get("class", "").split()[:2]) + (f"#{attrs['id']}" if attrs.get("id") else "")
        inside, left, named = stack[-1][2:] if stack else (False, False, False)
        article = name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
        left = left or (name in NOT_CONTENT and not (name == "header" and inside)) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        if name in BLOCK and name not in ("html", "body", "article", "main"):
            names = [attrs[k] for k in ("class", "id") if attrs.get(k)]
            left = left or any(map(FOREIGN.search, names))
            named = named or any(map(NAMES.search, names))
        stack.append((name, label, inside or article, left, named and not article))
    if at < len(page):
        hold(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- wrappers
# A page is a list of nodes: ("text", path, text or None, block), ("+", nodes).


def key(node: tuple) -> object:
    return (node[0], node[1]) if node[0] == "text" else (node[0], tuple(key(x) for x in node[1]))


def merge(a: list, b: list) -> list:
    """Two lists of nodes of the same keys: texts that differ become slots."""
    out = []
    for x, y in zip(a, b):
        out.append(("text", x[1], x[2] if x[2] == y[2] else None) if x[0] == "text" else (x[0], merge(x[1], y[1])))
    return out


def collapse(nodes: list, longest: int = 6) -> list:
    """Runs of equal neighbours of up to `longest` nodes become repeated groups."""
    for size in range(1, longest + 1):
        out, i = [], 0
        while i < len(nodes):
            unit, n = nodes[i : i + size], 1
            keys = [key(x) for x in unit]
            while len(unit) == size and i + (n + 1) * size <= len(nodes) and [key(x) for x in nodes[i + n * size : i + (n + 1) * size]] == keys:
                unit = merge(unit, nodes[i + n * size : i + (n + 1) * size])
                n += 1
            if n > 1:
                out.append(unit[0] if size == 1 and unit[0][0] == "+" else ("+", unit))
                i += n * size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def content(got: list[Block]) -> tuple[list[Block], bool]:
    """A page's blocks that can be content, and whether the page marks them as article or main part."""
    inside = [x for x in got if x.article and not x.left]
    return inside or [x for x in got if not x.left], bool(inside)


def groups(nodes: list) -> set[str]:
    """Paths of the texts in repeated groups."""
    out: set[str] = set()
    for node in nodes:
        if node[0] == "+":
            out |= {x[1] for x in node[1] if x[0] == "text"} | groups([x for x in node[1] if x[0] != "text"])
    return out


def plain_path(path: str) -> str:
    """A path without digits, which in labels number pages."""
    return re.sub(r"\d+", "", path)


def region_of(texts: list[tuple[str, int]]) -> str:
    """The innermost element that holds most of the text, of paths and lengths; an element with texts of its own isn't entered."""
    size: Counter[str] = Counter()
    whole = {plain_path(p) for p, _ in texts}
    for path, n in texts:
        parts = plain_path(path).split("/")
        for k in range(len(parts) + 1):
            size["/".join(parts[:k])] += n
    at = ""
    while True:
        below = [p for p in size if p.rpartition("/")[0] == at and p and p not in whole]
        best = max(below, key=lambda p: (size[p], p), default=None)
        if best is None or size[best] < REGION_SHARE * size[at]:
            return at
        at = best


Token = tuple[str, str, int]  # path (after @ on marked pages), text, and how many times the page had both before


def tokens(chosen: list[Block], marked: bool) -> list[Token]:
    """Of each block of a page's content, in order."""
    seen: Counter[tuple[str, str]] = Counter()
    out = []
    for x in chosen:
        own = ("@" + x.path if marked else x.path, x.text)
        out.append((*own, seen[own]))
        seen[own] += 1
    return out


def outer(chosen: list[Block], marked: bool) -> tuple[list[int], set[str]]:
    """The blocks of a page's content that can be the template's, outside repeated groups, and the paths in groups."""
    if marked and not any(x.named for x in chosen):
        return [], set()
    nodes = collapse([("text", x.path, x.text, i) for i, x in enumerate(chosen)])
    return [x[3] for x in nodes if x[0] == "text" and (chosen[x[3]].named or not marked)], groups(nodes)


def token_key(token: Token) -> bytes:
    return hashlib.blake2b("\n".join(map(str, token)).encode("utf-8", "replace"), digest_size=16).digest()


def page_keys(page: str) -> tuple[bool, bytes, list[bytes]]:
    """Whether a page's article is marked, a digest of its content, and the keys of what can be the template's."""
    chosen, marked = content(blocks(page))
    own = tokens(chosen, marked)
    digest = hashlib.blake2b(repr([tuple(x) for x in chosen]).encode("utf-8", "replace"), digest_size=16).digest()
    return marked, digest, [token_key(own[i]) for i in outer(chosen, marked)[0]]


def page_facts(page: str, fixed: set[bytes]) -> tuple[bytes, list[tuple[str, str | None, int, int, int, bool, bool]]]:
    """A page's digest, and of its fixed texts: path, text, number and place; of its other texts, by path: length, whether
    they are in a repeated group and all links (of pages without a marked article)."""
    chosen, marked = content(blocks(page))
    digest = hashlib.blake2b(repr([tuple(x) for x in chosen]).encode("utf-8", "replace"), digest_size=16).digest()
    free, repeated = outer(chosen, marked)
    own, out = tokens(chosen, marked), []
    held = {i for i in free if token_key(own[i]) in fixed}
    for i in sorted(held):
        out.append((*own[i], i, 0, False, True))
    slots: dict[str, list] = {}
    for i, x in enumerate(chosen if not marked else []):
        if i not in held:
            slot = slots.setdefault(x.path, [0, True])
            slot[0] += len(x.text)
            slot[1] = slot[1] and x.link
    return digest, out + [(path, None, 0, 0, size, path in repeated, link) for path, (size, link) in slots.items()]


def wrapper_of(facts: Iterable[tuple], unmarked: int) -> dict[str, list]:
    """A host's wrapper, from (path, text, number, mean place, length, repeated, all links) over its pages, and how many
    of the different ones have no marked article."""
    order, slots = [], []
    for path, text, k, place, size, repeated, link in facts:
        slots.append((path, size, repeated and link)) if text is None else order.append((place, path, text, k))
    template: dict[str, list] = {}
    for _, path, text, k in sorted(order):
        template.setdefault(path, []).append(text)
        template.setdefault(ORDER, []).append([path, text, k])
    if unmarked >= LEAST:
        menus = sorted(path for path, _, menu in slots if menu)
        if menus:
            template[MENUS] = menus
        template[REGION] = [region_of([(path, size) for path, size, menu in slots if not menu])]
    return template


def infer(pages: list[str]) -> dict[str, list]:
    """The wrapper of a few pages of one host, as `extract_pages` makes it of any number."""
    keys = {(marked, digest): own for marked, digest, own in map(page_keys, pages)}
    total = Counter(marked for marked, _ in keys)
    counts = Counter((marked, k) for (marked, _), own in keys.items() for k in own)
    fixed = {k for (marked, k), n in counts.items() if n >= max(LEAST, SHARE * total[marked])}
    if not fixed and total[False] < LEAST:
        return {}
    sums: dict[tuple, list] = {}
    for facts in dict(page_facts(page, fixed) for page in pages).values():
        for path, text, k, place, size, repeated, link in facts:
            x = sums.setdefault((path, text, k), [0, 0, 0, False, True])
            x[:] = x[0] + 1, x[1] + place, x[2] + size, x[3] or repeated, x[4] and link
    return wrapper_of(((*own, x[1] / x[0], *x[2:]) for own, x in sums.items()), total[False])


def rising(places: list[int]) -> list[int]:
    """The indexes of a longest rising run of different numbers."""
    ends, last, before = [], [], []
    for n, place in enumerate(places):
        r = bisect_left(ends, place)
        ends[r : r + 1], last[r : r + 1] = [place], [n]
        before.append(last[r - 1] if r else None)
    n, out = last[-1] if last else None, []
    while n is not None:
        out.append(n)
        n = before[n]
    return out[::-1]


def aligned(chosen: list[Block], marked: bool, template: dict[str, list]) -> set[int]:
    """The blocks of a page's content that are the template's: its fixed texts as far as they come in the wrapper's order."""
    order = {tuple(x): i for i, x in enumerate(template.get(ORDER, ()))}
    if not order:
        return set()
    found = [(i, order[t]) for i, t in enumerate(tokens(chosen, marked)) if t in order and (chosen[i].named or not marked)]
    return {found[n][0] for n in rising([place for _, place in found])}


def article_text(page: str, template: dict[str, list]) -> str:
    chosen, marked = content(blocks(page))
    fixed = aligned(chosen, marked, template)
    left = [x for i, x in enumerate(chosen) if i not in fixed]
    if not marked and REGION in template:
        region, menus = template[REGION][0], template.get(MENUS, ())
        inside = lambda x: not region or (plain_path(x.path) + "/").startswith(region + "/")
        if any(map(inside, chosen)):
            left = [x for x in left if inside(x)]
        left = [x for x in left if x.path not in menus]
    elif not marked:
        left = [x for x in left if not x.named]
    return "\n".join(x.text for x in left)


# ---------------------------------------------------------------- over all pages


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


HOSTS = "host string, template string"
KEYS = "host string, marked boolean, digest binary, keys array<binary>"
FACTS = "host string, digest binary, facts array<struct<path string, text string, k int, place int, size int, repeated boolean, link boolean>>"
FACT = pa.struct([("path", pa.string()), ("text", pa.string()), ("k", pa.int32()), ("place", pa.int32()), ("size", pa.int32()), ("repeated", pa.bool_()), ("link", pa.bool_())])


def keys_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYS, of each page."""
    for batch in batches:
        got = [page_keys(page or "") for page in batch.column("html").to_pylist()]
        cols = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.bool_(), pa.binary(), pa.list_(pa.binary())))]
        yield pa.RecordBatch.from_arrays([batch.column("host"), *cols], names=["host", "marked", "digest", "keys"])


def facts_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FACTS, of each page; its host's `template` has the keys of the fixed texts."""
    fixed: dict[str, set[bytes]] = {}
    for batch in batches:
        got = []
        for page, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            if t not in fixed:
                if len(fixed) > 1000:
                    fixed.clear()
                fixed[t] = set(map(bytes.fromhex, json.loads(t)))
            got.append(page_facts(page or "", fixed[t]))
        facts = [[dict(zip(FACT.names, x)) for x in rows] for _, rows in got]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([d for d, _ in got], pa.binary()), pa.array(facts, pa.list_(FACT))], names=["host", "digest", "facts"])


def wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of HOSTS from a list of facts over all pages of each host."""
    for batch in batches:
        for h, unmarked, facts in zip(*(batch.column(c).to_pylist() for c in ("host", "unmarked", "facts"))):
            if t := wrapper_of(((x["path"], x["text"], x["k"], x["places"] / x["n"], x["size"], x["repeated"], x["link"]) for x in facts or []), unmarked):
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.string()), pa.array([json.dumps(t)], pa.string())], names=["host", "template"])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            if t and t not in templates:
                if len(templates) > 1000:
                    templates.clear()
                templates[t] = json.loads(t)
            texts.append(article_text(page or "", templates[t] if t else {}))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def small(frame: DataFrame, *columns: str) -> bool:
    """Whether the frame's columns have few enough bytes to be broadcast."""
    return (frame.agg(F.sum(sum((F.length(c) for c in columns), F.lit(8)))).first()[0] or 0) <= BROADCAST


def with_wrappers(rows: DataFrame, hosts: DataFrame, how: str, scratch: Scratch) -> DataFrame:
    """rows with their host's wrapper: broadcast if all are small, else dealt by host but for hosts of many rows."""
    hosts = hosts.select("host", "template")
    if small(hosts, "host", "template"):
        return rows.join(F.broadcast(hosts), "host", how)
    counts = scratch.cut(hosts.join(rows.groupBy("host").agg(F.count("*").alias("rows")), "host"))
    return hot_join(rows, counts, ["host"], "rows", rows.count(), how)


def extract_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    # copies count once: digests are dealt, of which there is one a page, and never a host
    seen = scratch.cut(rows.select("host", "html").mapInArrow(keys_on, KEYS).groupBy("host", "marked", "digest").agg(F.first("keys").alias("keys")))
    totals = scratch.cut(seen.groupBy("host", "marked").agg(F.count("*").alias("total")))
    counts = seen.select("host", "marked", F.explode("keys").alias("key")).groupBy("host", "marked", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    fixed = counts.join(totals, ["host", "marked"]).filter(F.col("n") >= SHARE * F.col("total")).groupBy("host").agg(F.sort_array(F.collect_list(F.lower(F.hex("key")))).alias("keys"))
    unmarked = totals.groupBy("host").agg(F.sum(F.when(~F.col("marked"), F.col("total")).otherwise(0)).alias("unmarked"))
    some = scratch.cut(unmarked.join(fixed, "host", "left").filter((F.col("unmarked") >= LEAST) | F.col("keys").isNotNull()).select("host", "unmarked", F.to_json(F.coalesce("keys", F.array().cast("array<string>"))).alias("template")))
    scratch.drop(seen, totals)
    facts = with_wrappers(rows, some, "inner", scratch).select("host", "html", "template").mapInArrow(facts_on, FACTS).groupBy("host", "digest").agg(F.first("facts").alias("facts"))
    by_path = facts.select("host", F.explode("facts").alias("f")).groupBy("host", "f.path", "f.text", "f.k").agg(F.count("*").alias("n"), F.sum("f.place").alias("places"), F.sum("f.size").alias("size"), F.max("f.repeated").alias("repeated"), F.min("f.link").alias("link"))
    by_host = by_path.groupBy("host").agg(F.collect_list(F.struct("path", "text", "k", "n", "places", "size", "repeated", "link")).alias("facts"))
    hosts = scratch.cut(some.select("host", "unmarked").join(by_host, "host", "left").mapInArrow(wrappers, HOSTS))
    scratch.drop(some)
    return with_wrappers(rows, hosts, "left", scratch).select("page_id", "url", "html", "template").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), Scratch(spark, "op3"))
