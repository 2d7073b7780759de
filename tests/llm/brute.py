"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def find(self, x):
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(rows, percent=85):
    """doc_id -> (set size, component) for rows of distinct ids."""
    sets = {d: shingle_set(t) for d, t in rows}
    groups = Sets(sets)
    first: dict = {}
    for d, s in sets.items():
        if s:
            groups.tie(first.setdefault(s, d), d)
    every = sorted(first.items(), key=lambda x: len(x[0]))
    df = Counter(x for s, _ in every for x in s)
    index = defaultdict(list)
    for k, (s, d) in enumerate(every):
        own = sorted(s, key=lambda x: (df[x], x))[: len(s) - (percent * len(s) + 99) // 100 + 1]
        for j in {j for x in own for j in index[x]}:
            both = len(s & every[j][0])
            if 100 * both >= percent * (len(s) + len(every[j][0]) - both):
                groups.tie(every[j][1], d)
        for x in own:
            index[x].append(k)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def secret_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def repeats(texts, length=400):
    """(bytes, removed, spans, hash of the rest) of each text."""
    own = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in own for i in range(len(b) - length + 1))
    out = []
    for b in own:
        hit = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        runs = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mixed_targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target, by resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def shared_passages(rows, words=50):
    """How many passages of so many words of each of the rows (id, text) another row holds too; equal rows count as one."""
    own = {r: [m.span() for m in WORD.finditer(r[1] or "")] for r in set(rows)}
    cut = {r: [r[1][at[i][0] : at[i + words - 1][1]] for i in range(len(at) - words + 1)] for r, at in own.items()}
    held = Counter(x for passages in cut.values() for x in set(passages))
    return [sum(held[x] > 1 for x in cut[r]) for r in rows]
