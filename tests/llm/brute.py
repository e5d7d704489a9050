"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def similar(a: set, b: set, num: int, den: int) -> bool:
    both = len(a & b)
    return bool(a) and bool(b) and den * both >= num * (len(a) + len(b) - both)


def ngram_components(docs: dict, n=4, num=85, den=100) -> dict:
    """id -> (n_shingles, component)."""
    sets = {}
    for i, t in docs.items():
        w = words(t, True)
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(docs)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similar(sets[a], sets[b], num, den)]
    part = components(ids, edges)
    return {i: (len(sets[i]), part[i]) for i in ids}


def without_repeats(docs: dict, window=50) -> dict:
    """id -> (n_words, n_removed, digest)."""
    first = {}
    split = {i: words(t) for i, t in docs.items()}
    for i in sorted(docs):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def lines_removed(docs: dict, least=1, k=8, num=80, den=100) -> dict:
    """id -> numbers of the lines that go."""
    places = defaultdict(list)
    for i in sorted(docs):
        for n, line in enumerate((docs[i] or "").split("\n")):
            if len(line.strip()) >= least:
                places[line.strip()].append((i, n))
    texts = list(places)
    sets = [{t[j : j + k] for j in range(max(1, len(t) - k + 1))} for t in texts]
    edges = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similar(sets[a], sets[b], num, den)]
    part = components(range(len(texts)), edges)
    groups = defaultdict(list)
    for n, t in enumerate(texts):
        groups[part[n]] += places[t]
    out = {i: set() for i in docs}
    for found in groups.values():
        for i, n in sorted(found)[1:]:
            out[i].add(n)
    return out
