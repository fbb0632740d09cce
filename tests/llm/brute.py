"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACED.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = [False] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            hit[k : k + 5] = [True] * 5
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(hit)}


def repeated(units, width):
    """{id: flags} of the units that a repeated window covers."""
    seen = collections.Counter()
    for u in units.values():
        seen.update(tuple(u[k : k + width]) for k in range(len(u) - width + 1))
    out = {}
    for i, u in units.items():
        g = [False] * len(u)
        for k in range(len(u) - width + 1):
            if seen[tuple(u[k : k + width])] > 1:
                g[k : k + width] = [True] * width
        out[i] = g
    return out


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(texts, items, n=8):
    found = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            found[tuple(w[s : s + k])].add(item)
    lengths = {len(k) for k in found}
    out = {}
    for i, text in texts.items():
        w = ALNUM.findall(lower(text))
        hit, got = [False] * len(w), set()
        for s in range(len(w)):
            for k in lengths:
                if s + k <= len(w) and tuple(w[s : s + k]) in found:
                    hit[s : s + k] = [True] * k
                    got |= found[tuple(w[s : s + k])]
        out[i] = (len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), len(got) >= 2)
    return out
