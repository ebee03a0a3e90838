"""Plain Python versions of the operators' contracts."""

import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def contamination(docs, items, size=13):
    """docs, items: (id, text) -> {doc_id: (n_words, hit positions, items)}"""
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    lengths = sorted({len(x) for x in windows})
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out[doc] = (len(w), hit, found)
    return out


def repeats(docs, size=20):
    """{doc_id: (n_words, n_removed, kept text)}; ids are distinct"""
    first, rows, out = {}, [], {}
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = PLAIN.findall(text or "")
        rows.append((doc, w))
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (doc, i))
    for doc, w in rows:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (doc, i):
                gone |= set(range(i, i + size))
        out[doc] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def fingerprint(text, size=4):
    w = PLAIN.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(prints, bits=4):
    """[(doc_id, fingerprint)] -> smallest id reachable, per row"""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(prints):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return [low[find(i)] for i in range(len(prints))]


def unigrams(docs, held):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    tokens = {d: [*PLAIN.findall((t or "").translate(LOWER)), None] for d, t in docs}
    c = Counter(w for d in tokens if not held(d) for w in tokens[d])
    n, v = sum(c.values()), len(c)
    return {d: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            for d, w in tokens.items()}
