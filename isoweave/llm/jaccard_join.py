"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Adaptive multi-match prefixes. Shingles have one global order, those that a count sketch of the whole corpus holds
for frequent last. With similarity t, two linked sets x and y share at least L of the first |x| - ceil(t|x|) + L
and |y| - ceil(t|y|) + L shingles, for any L. Each document takes its own L: of a few multiples of a base that
grows with |x|, the one with the least estimated cost, that is the length of its prefix and, divided by L, the
partners that the sketch expects its prefix to meet. A pair has to share min(Lx, Ly) prefix shingles.

1. Documents with equal sets (by count and two 64-bit sums) are one set, named by its least doc_id.
2. Prefix shingles are dealt by themselves. A set that shares too few with others to be linked with any is done;
   on ordinary text that is most of them, and only counts leave this step.
3. Those left take their prefix to its longest, the whole set: what shares fewer than ceil(t|x|) of its shingles with
   others that are left can't be linked. Of the rest, in true order of frequency, the first prefix ties documents:
   each shingle ties all that have it to the least of them. No two linked documents end in different families.
4. The texts of a family meet in one task and are verified there: a document is counted against all others over an
   inverted index, until all that are still uncounted have become one component. A link counts only if the shingles
   compare equal as words. Of families too big for one task, all documents first meet a few of their members; those
   that link with these need not meet each other again, only those that don't.

Sets are gathered by 64-bit hashes of shingles, so a set's size is wrong by the number of collisions within it; and
two sets whose 64-bit sums collide count as one in step 2.

Defined cases: null texts and texts without words have an empty set and are linked with nothing. Texts of one to
four words have one shingle, the whole. Texts of any length are taken whole. Ties: a component is named by its least
doc_id. doc_id is a key; repeated rows of one doc_id with the same text give the same row each. A null doc_id is
linked as its text's other rows are, or with nothing. Extra columns are ignored by `near_duplicates` and returned by
`first_of_each`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Scratch, gram_hashes, hot_join, mix, split_by_ids, table, text_blocks, word_hashes, words

SHINGLE = 5
SKETCH_BITS, SKETCH_ROWS = 18, 64
#: Multiples of the least L that a document chooses from.
TIMES = (1, 2, 4)
#: Shingles that one verifying task holds at most, unless a single document has more.
FAMILY = 2_000_000
#: Documents of a family of several tasks that all others meet first.
HUBS = 16
#: Shingles that the sketch expects in 2**SPREAD_CLASS documents or more are dealt to SPREAD partitions.
SPREAD_CLASS, SPREAD = 12, 64
#: Rows of one shingle that a task holds at a time; of shingles with more, all documents count as sharing it.
GROUP = 1 << 17
#: Distinct sets that a task remembers, so that copies of them send nothing.
SEEN = 1 << 20


def shingle_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's shingles (repeated ones too) and the first of each document, one more at the end."""
    low = LOWER[buf]
    start, end, first = words(low, offs, SPACED)
    h = word_hashes(low, start, end)
    per = np.diff(first)
    n = np.where(per >= SHINGLE, per - SHINGLE + 1, np.minimum(per, 1))
    out_first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(out_first[-1], np.uint64)
    doc = np.repeat(np.arange(len(per)), n)
    at = first[doc] + np.arange(len(out)) - out_first[doc]
    for k in range(1, SHINGLE + 1):
        of = np.minimum(per, SHINGLE)[doc] == k
        if of.any():
            out[of] = mix(gram_hashes(h, k)[at[of]] + np.uint64(k))
    return out, out_first


# ---------------------------------------------------------------- sets and sketch


SETS = "doc_id long, n long, s1 long, s2 long, part int, counts binary"


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and two sums of hashes; at the end the task's counts of shingles by the low bits
    of their hashes, in SKETCH_ROWS rows."""
    counts, cells = np.zeros(1 << SKETCH_BITS, np.int64), np.uint64((1 << SKETCH_BITS) - 1)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in SETS.split(", ")]
    for rows, buf, offs in text_blocks(batches):
        h, first = shingle_hashes(buf, offs)
        out, held = [], []
        for doc, a, b in zip(rows.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
            if a == b:
                out.append((doc, 0, doc, 0, None, None))
                continue
            k = np.unique(h[a:b])
            held.append((k & cells).astype(np.int64))
            out.append((doc, len(k), int(mix(k).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(k + np.uint64(0x51))).astype(np.int64)), None, None))
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
    if counts.any():
        none = [None] * SKETCH_ROWS
        parts = [x.astype("<u4").tobytes() for x in np.minimum(counts, (1 << 32) - 1).reshape(SKETCH_ROWS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none] * 4 + [range(SKETCH_ROWS), parts], types)], names=names)


def sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(c, "<u4").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])


def expected_partners(sets: DataFrame) -> np.ndarray:
    """Of each cell of the sketch the documents that a shingle in it may be in, beyond what chance puts there.

    The sketch is of fixed size (SKETCH_ROWS rows), so it may come to the driver and be broadcast.
    """
    rows = sets.filter("part IS NOT NULL").select("part", "counts").repartition(SKETCH_ROWS, "part").mapInArrow(sum_sketches, "part int, counts binary")
    out = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    for row in rows.collect():
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
    usual = np.median(out)
    return 1 + np.maximum(0, out.reshape(-1) - usual - 4 * np.sqrt(usual))


# ---------------------------------------------------------------- prefixes


def base_match(n: np.ndarray | int) -> np.ndarray | int:
    """The least L of a set of n shingles; partners have at least (4n + 4) // 5."""
    return 1 + n // 12


def required(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with a linked one at least."""
    return (4 * n + 4) // 5


def choice(n: int, expected: np.ndarray) -> tuple[int, int, int]:
    """The multiple, L and the length of the prefix of a set of n, for the partners expected of each of its sorted shingles."""
    base, need = base_match(n), required(n)
    total = np.cumsum(expected)
    best = None
    for times in TIMES:
        match = min(base * times, need)
        length = n - need + match
        cost = length + n / 16 * total[length - 1] / match
        if best is None or cost < best[0]:
            best = (cost, times, match, length)
    return best[1:]


def prefix_of(keys: np.ndarray, expected: np.ndarray) -> tuple[int, int]:
    """L and the length of the prefix, for sorted keys and the partners expected of each."""
    return choice(len(keys), expected)[1:]


TOKENS = "token long, owner long, info long"


def info_of(n: np.ndarray, times: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A set's size (40 bits), its multiple and a shingle's salt (0 for those that aren't spread) in one number."""
    return (salt.astype(np.int64) << 48) | (times.astype(np.int64) << 40) | n


def tokens_of(shared: object, whole: bool) -> Callable:
    """Rows (shingle, set, info) of the prefixes, the sets by their first sum; or with `whole` of all shingles, the sets by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners, seen = shared.value, set()
        level = np.floor(np.log2(partners)).astype(np.int64)
        cells = np.uint64(len(partners) - 1)
        for rows, buf, offs in text_blocks(batches):
            h, first = shingle_hashes(buf, offs)
            keys, owners, sizes, multiples = [], [], [], []
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
                if a == b:
                    continue
                k, times = np.unique(h[a:b]), 1
                owner, n = doc, len(k)
                if not whole:
                    owner = int(mix(k).sum().astype(np.int64))
                    if owner in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(owner)
                    cell = (k & cells).astype(np.int64)
                    order = np.argsort(level[cell], kind="stable")
                    times, _, length = choice(n, partners[cell[order]])
                    k = k[order[:length]]
                elif doc is None:
                    continue
                keys.append(k)
                owners.append(owner)
                sizes.append(n)
                multiples.append(times)
            if not keys:
                continue
            lens = [len(k) for k in keys]
            owner = np.repeat(np.array(owners, np.int64), lens)
            token = np.concatenate(keys)
            spread = level[(token & cells).astype(np.int64)] >= SPREAD_CLASS
            salt = np.where(spread, 1 + mix(owner.astype(np.uint64)) % np.uint64(SPREAD), 0)
            info = info_of(np.repeat(np.array(sizes, np.int64), lens), np.repeat(np.array(multiples, np.int64), lens), salt)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(owner), pa.array(info)], names=["token", "owner", "info"])

    return run


def by_token(tokens: DataFrame) -> DataFrame:
    """Dealt and sorted so that a shingle's rows come one after the other, but for those that are spread."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartition(parts, "token", F.shiftright("info", 48)).sortWithinPartitions("token", "owner")


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], most: int | None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows sorted by the first, its groups together; and flags of groups of over `most` rows, which come in pieces."""
    held, cut = None, None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key = cols[0]
        if not len(key):
            continue
        before = np.flatnonzero(key != key[-1])
        begin = int(before[-1]) + 1 if len(before) else 0
        if most is not None and len(key) - begin > most:
            yield cols, (key == key[-1]) | ((key == cut) if cut is not None else False)
            held, cut = None, key[-1]
        else:
            if begin:
                yield [c[:begin] for c in cols], (key[:begin] == cut) if cut is not None else np.zeros(begin, bool)
            held = [c[begin:] for c in cols]
    if held is not None and len(held[0]):
        yield held, (held[0] == cut) if cut is not None else np.zeros(len(held[0]), bool)


def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(token, owner, info, sets that have the shingle, least multiple among the others) of rows whose shingle others have too."""
    for (token, owner, info), cut in whole_groups(batches, ["token", "owner", "info"], GROUP):
        own = np.ones(len(token), bool)
        own[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, info, cut = token[own], owner[own], info[own], cut[own]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.concatenate((begin, [len(token)])))
        group = np.repeat(np.arange(len(begin)), size)
        times = (info >> 40) & 0xFF
        order = np.lexsort((times, group))  # the least of each group first, then the next
        least, second = times[order[begin]], times[order[np.minimum(begin + 1, len(order) - 1)]]
        other = np.where(np.arange(len(token)) == order[begin][group], second[group], least[group])
        known = ~cut & ((info >> 48) == 0)
        keep = ~known | (size[group] > 1)
        yield token[keep], owner[keep], info[keep], np.where(known, size[group], 0)[keep], np.where(known, other, 1)[keep]


def shared_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row that is shared: set, size, its multiple and the least among the others."""
    for _, owner, info, _, other in sharing(batches):
        cols = [owner, info & ((1 << 40) - 1), ((info >> 40) & 0xFF).astype(np.int32), other.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["owner", "n", "times", "other"])


def shared_whole(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row that is shared: document, size, shingle and the number of documents that have it (of those spread, as expected)."""
        partners = shared.value
        for token, owner, info, df, _ in sharing(batches):
            guess = partners[(token.view(np.uint64) & np.uint64(len(partners) - 1)).astype(np.int64)].astype(np.int64) + GROUP
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (owner, info & ((1 << 40) - 1), token, np.where(df == 0, guess, df))], names=["owner", "n", "token", "df"])

    return run


def need(n: str) -> str:
    return f"((4 * {n} + 4) DIV 5)"


def screened(docs: DataFrame, shared: object) -> DataFrame:
    """(owner): first sums of the sets whose prefixes share enough with others to be linked with any.

    A linked partner of multiple m has at least min(times, m) * floor in common with the prefix, in shingles that other
    sets of multiple m or less have; floor is the base of the smallest set that can be a partner.
    """
    rows = by_token(docs.mapInArrow(tokens_of(shared, False), TOKENS)).mapInArrow(shared_prefix, "owner long, n long, times int, other int")
    counts = [F.count(F.when(F.col("other") <= m, 1)).alias(f"c{m}") for m in TIMES]
    got = rows.groupBy("owner").agg(F.first("n").alias("n"), F.first("times").alias("times"), *counts)
    floor, most = f"(1 + {need('n')} DIV 12)", need(need("n"))
    return got.filter(" OR ".join(f"c{m} >= least(least(times, {m}) * {floor}, {most})" for m in TIMES)).select("owner")


def common_enough(some: DataFrame, shared: object) -> DataFrame:
    """(owner, n) of documents that share at least the required number of their shingles with others of `some`."""
    rows = by_token(some.mapInArrow(tokens_of(shared, True), TOKENS)).mapInArrow(shared_whole(shared), "owner long, n long, token long, df long")
    return rows.groupBy("owner").agg(F.first("n").alias("n"), F.count("*").alias("c")).filter(f"c >= {need('n')}").select("owner", "n")


def first_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's shared shingles, sorted by frequency: those of which it shares one at least with any partner."""
    for (owner, n, token), _ in whole_groups(batches, ["owner", "n", "token"], None):
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.concatenate((begin, [len(owner)])))
        rank = np.arange(len(owner)) - np.repeat(begin, size)
        keep = rank <= np.repeat(size, size) - required(n)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, owner, n)], names=["token", "owner", "n"])


# ---------------------------------------------------------------- families


def is_empty(frame: DataFrame) -> bool:
    return not frame.limit(1).count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root) of every node that isn't its component's least, from edges (a, b); None if there are none.

    Each node hooks to its least smaller neighbour, paths are halved until they are stars, and edges are renamed by
    the roots; what still joins two roots goes round again. All steps' tables go but the result.
    """
    order = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rename = lambda e, c: e.join(parent.select(F.col("a").alias(c), F.col("b").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    made: list[DataFrame] = []

    def cut(frame: DataFrame) -> DataFrame:
        made.append(scratch.cut(frame))
        return made[-1]

    edges, roots = cut(order(edges)), None
    while not is_empty(edges):
        parent = cut(edges.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            up = parent.select(F.col("a").alias("b"), F.col("b").alias("c"))
            if is_empty(parent.join(up, "b", "left_semi")):
                break
            parent = cut(parent.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        if roots is None:
            roots = parent
        else:
            moved = roots.join(parent.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
            roots = cut(moved.unionByName(parent.select("a", "b")))
        edges = cut(order(rename(rename(edges, "a"), "b")))
    scratch.drop(*(x for x in made if x is not roots))
    return None if roots is None else roots.select(F.col("a").alias("node"), F.col("b").alias("root"))


def families(some: DataFrame, shared: object, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(owner, n) of the documents that may be linked, and (node, root) of those that join a family under another's name."""
    spark = some.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = by_token(some.mapInArrow(tokens_of(shared, True), TOKENS)).mapInArrow(shared_whole(shared), "owner long, n long, token long, df long")
    ties = scratch.cut(rows.repartition(parts, "owner").sortWithinPartitions("owner", "df", "token").mapInArrow(first_prefix, "token long, owner long, n long"))
    lead = scratch.cut(ties.groupBy("token").agg(F.min("owner").alias("b"), F.count("*").alias("k")).filter("k > 1"))
    edges = hot_join(ties.select("token", F.col("owner").alias("a")), lead, ["token"], "k", ties.count()).select("a", "b").distinct()
    found = components(edges, scratch)
    everyone = scratch.cut(ties.groupBy("owner").agg(F.first("n").alias("n")))
    scratch.drop(ties, lead)
    return everyone, found


# ---------------------------------------------------------------- verification


def word_shingles(text: bytes) -> set[bytes]:
    """A text's shingles as they are, by other means than the hashes."""
    w = text.translate(bytes(LOWER)).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    w = [x for x in w if x]
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, min(len(w), 1)))}


class Family:
    """Documents of one verifying task: their names, texts and sets of hashes."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.texts: list[bytes] = []
        self.sets: list[np.ndarray] = []

    def equal(self, x: int, y: int) -> bool:
        """Whether x and y are linked by their shingles as words."""
        a, b = word_shingles(self.texts[x]), word_shingles(self.texts[y])
        return 9 * len(a & b) >= 4 * (len(a) + len(b))

    def links(self, hubs: int = 0) -> list[tuple[int, int]]:
        """Links that make up the components of all documents, exactly; or with `hubs` all links with the first `hubs`."""
        n = np.array([len(s) for s in self.sets])
        _, token = np.unique(np.concatenate(self.sets), return_inverse=True)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(token, kind="stable")
        having, begin = doc[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
        first, out = np.cumsum(n) - n, []
        parent, size, biggest = list(range(len(n))), [1] * len(n), 0

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def count(x: int) -> None:
            """Joins x with all that it is linked with."""
            nonlocal biggest
            t = token[first[x] : first[x] + n[x]]
            shared = np.zeros(len(n), np.int64)
            for i in range(0, len(t), 4096):
                lens = begin[t[i : i + 4096] + 1] - begin[t[i : i + 4096]]
                at = np.repeat(begin[t[i : i + 4096]] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                shared += np.bincount(having[at], minlength=len(n))
            for y in np.flatnonzero(9 * shared >= 4 * (n + n[x])).tolist():
                a, b = root(x), root(y)
                if a != b and self.equal(x, y):
                    out.append((self.docs[x], self.docs[y]))
                    low = min(a, b)
                    parent[max(a, b)] = low
                    size[low] = size[a] + size[b]
                    if size[low] >= size[root(biggest)]:
                        biggest = low

        if hubs:
            for x in range(min(hubs, len(n))):
                count(x)
            return out
        # pairs with a counted document are known; once the uncounted are all of one component, nothing can change
        waiting = list(range(len(n)))
        while len({root(i) for i in waiting}) > 1:
            rest = []
            for x in waiting:
                if size[root(biggest)] > 1 and root(x) == root(biggest):
                    rest.append(x)
                else:
                    count(x)
            waiting = rest
        return out


def verify(hubs: int) -> Callable:
    """(a, b): links of the rows of each (fam, part), which come together, the first `hubs` of them before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, family = None, Family()

        def result() -> pa.RecordBatch:
            got = family.links(hubs) if len(family.docs) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

        for rows, buf, offs in text_blocks(batches):
            h, first = shingle_hashes(buf, offs)
            for d, (fam, part, doc) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("fam", "part", "doc_id")))):
                if (fam, part) != name:
                    if family.docs:
                        yield result()
                    name, family = (fam, part), Family()
                family.docs.append(doc)
                family.texts.append(buf[offs[d] : offs[d + 1]].tobytes())
                family.sets.append(np.unique(h[first[d] : first[d + 1]]))
        if family.docs:
            yield result()

    return run


def verified(texts: DataFrame, members: DataFrame, scratch: Scratch, hubs: int = 0) -> DataFrame:
    """Links among the rows of each (fam, part). members: fam, part, doc_id, first (true for the first `hubs`)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.join(members, "doc_id").repartition(parts, "fam", "part").sortWithinPartitions("fam", "part", F.desc("first"), "doc_id")
    return scratch.cut(rows.select("fam", "part", "doc_id", "text").mapInArrow(verify(hubs), "a long, b long"))


def big_families(texts: DataFrame, members: DataFrame, family: int, scratch: Scratch) -> DataFrame:
    """Links of families of several tasks. members: fam, doc_id, n, blocks.

    All documents meet the family's hubs; the largest component of these links is its core. Pairs within the core are
    known to be connected; the others meet each other and the core, block by block.
    """
    block = lambda k: F.pmod(F.xxhash64("doc_id"), k).cast("int")
    hub = members.withColumn("r", F.row_number().over(Window.partitionBy("fam").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("r") <= HUBS)
    hub = scratch.cut(hub.select("fam", "doc_id", "blocks"))
    met = hub.select("fam", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "doc_id", F.lit(True).alias("first"))
    others = members.join(hub.select("fam", "doc_id"), ["fam", "doc_id"], "left_anti").select("fam", block(F.col("blocks")).alias("part"), "doc_id", F.lit(False).alias("first"))
    links = verified(texts, met.unionByName(others), scratch, HUBS)
    found = components(links, scratch)
    named = members.withColumn("root", F.col("doc_id")) if found is None else members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sizes = named.groupBy("fam", "root").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    core = sizes.groupBy("fam").agg(F.max(F.struct("k", "root")).alias("c"), F.sum("all").alias("total"))
    core = core.join(sizes.select("fam", F.col("root").alias("_root"), F.col("all")), "fam").filter("_root = c.root")
    core = scratch.cut(core.select("fam", "_root", F.ceil(F.col("all") / family).cast("int").alias("cores"), F.ceil((F.col("total") - F.col("all")) / family).cast("int").alias("rests")).filter("rests > 0"))
    rows = scratch.cut(named.join(core, "fam").select("fam", "doc_id", (F.col("root") == F.col("_root")).alias("core"), "cores", "rests"))
    # part (i, j): block i of all that is left with block j; blocks of the core are numbered after those of the rest
    number = lambda i, j: i * F.col("rests") + j
    mine = block(F.col("rests"))
    inner = rows.filter("core").select("fam", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: number(F.col("rests") + block(F.col("cores")), j))).alias("part"))
    outer = F.concat(F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: number(F.greatest(j, mine), F.least(j, mine))), F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda i: number(F.col("rests") + i, mine)))
    outer = rows.filter("NOT core").select("fam", "doc_id", F.explode(outer).alias("part"))
    more = verified(texts, inner.unionByName(outer).withColumn("first", F.lit(False)), scratch)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, scratch: Scratch, family: int = FAMILY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = scratch.cut(docs.mapInArrow(sets_of, SETS))
    shared = spark.sparkContext.broadcast(expected_partners(seen))
    sets = seen.filter("part IS NULL").select("doc_id", "n", "s1", "s2")
    key = ["s1", "s2", "n"]
    distinct = scratch.cut(sets.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")))

    owners = scratch.cut(screened(docs, shared).withColumnRenamed("owner", "s1"))
    reps = scratch.cut(distinct.join(owners, "s1", "left_semi").filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")))
    texts = scratch.cut(split_by_ids(docs, reps)[0].join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    scratch.drop(owners, reps)
    left = scratch.cut(common_enough(texts, shared))
    fewer = scratch.cut(texts.join(left.select(F.col("owner").alias("doc_id")), "doc_id", "left_semi"))
    scratch.drop(texts, left)
    everyone, named = families(fewer, shared, scratch)

    found = None
    if named is not None:
        members = everyone.join(named.withColumnRenamed("node", "owner"), "owner", "left").select(F.col("owner").alias("doc_id"), "n", F.coalesce("root", "owner").alias("fam"))
        sizes = members.groupBy("fam").agg(F.count("*").alias("k"), F.sum("n").alias("all")).filter("k > 1").select("fam", F.ceil(F.col("all") / family).cast("int").alias("blocks"))
        members = scratch.cut(members.join(sizes, "fam"))
        links = verified(fewer, members.filter("blocks = 1").select("fam", F.lit(0).alias("part"), "doc_id", F.lit(False).alias("first")), scratch)
        if not is_empty(members.filter("blocks > 1")):
            links = links.unionByName(big_families(fewer, members.filter("blocks > 1"), family, scratch))
        found = components(links, scratch)
        scratch.drop(members)
    scratch.drop(fewer)

    classes = distinct.withColumn("component_id", F.col("rep"))
    if found is not None:
        classes = distinct.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    classes = scratch.cut(classes.filter("k > 1 OR component_id != rep").select(*key, "component_id", "k"))
    out = hot_join(sets.filter("n > 0"), classes, key, "k", sets.count(), "left")
    return out.unionByName(sets.filter("n = 0"), allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs less those that are linked, over any number of links, with one of a smaller doc_id."""
    later = scratch.cut(near_duplicates(docs.select("doc_id", "text"), scratch).filter("component_id != doc_id").select("doc_id").distinct())
    maybe, others = split_by_ids(docs, later)  # so that few texts are dealt for the join
    return others.unionByName(maybe.join(later, "doc_id", "left_anti").select(*docs.columns))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
