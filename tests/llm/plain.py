"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import struct

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    b = (text or "").encode()
    if lower:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return WORD.findall(b)


def kept_words(docs, length=50):
    """{doc_id: (n_words, n_removed, sha256)}; docs: list of (doc_id, text) with distinct ids."""
    cut = {i: words(t) for i, t in docs}
    first = {}
    for i in sorted(cut):
        w = cut[i]
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = {}
    for i, w in cut.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def simhash(text, shingle=3):
    w = words(text, lower=True)
    if not w:
        return 0
    k = min(shingle, len(w))
    h = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    """{id: smallest id reachable}; linked(a, b) says whether two positions are linked."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b) and root(a) != root(b):
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, i in enumerate(ids)}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)
