"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=3):
    w = [x.translate(LOWER) for x in words(text)]
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(rows, size=3, per_cent=90):
    """(doc_id, text) to {doc_id: least doc_id reachable}."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def removed(rows, length=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1 if i is not None else 0):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for i, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in windows:
                    hit.update(range(at, at + k))
                    found |= windows[tuple(w[at : at + k])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def rule_counts(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def base_scores(rows):
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    texts = [(i, [x.translate(LOWER) for x in words(t)] + [None]) for i, t in rows]
    c = collections.Counter()
    for i, w in texts:
        if learned(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    below = math.log10(n + 0.5 * (v + 1))
    return [(i, not learned(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(c[x] + 0.5) - below for x in w)) for i, w in texts]


def token_digests(rows, encode):
    """(doc_id, start, n_tokens, crc) of rows already in order."""
    out, start = [], 0
    for i, text in rows:
        ids = [*encode(text or ""), 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def mix(rows, weights=(3, 1, 2)):
    """(doc_id, source, size) to {doc_id: (target, taken)}, by sharing again what is above."""
    total = collections.Counter()
    for _, source, size in rows:
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    out = {}
    for source in order:
        at = 0
        mine = [(i, n) for i, s, n in rows if s == source]
        for i, n in sorted(mine, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            times = sum(k * total[source] + at + n / 2 <= target[source] for k in (0, 1))
            out[i] = (target[source], times * n)
            at += n
    return out
