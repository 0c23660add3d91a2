"""Byte-level BPE encoding and decoding by merge replay.

A block of texts is split into pieces by the vocabulary's pattern. Its distinct new pieces stand in one array of
symbols; an inverted index leads from each token pair (by the rank of what it merges to) to the places where it stands, and
ranks are taken in order from a heap. A merge at a place touches its two neighbours alone: their pairs are looked up
and entered in the index. Each distinct piece is thus replayed once per block, whatever its count.

Ids travel as binary columns of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import memory

#: The split pattern of the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_PIECES = 300_000  # encoded pieces that a task keeps
BLOCK_BYTES = 2 << 20  # text replayed at once
LONG_PIECE = 4096  # bytes; longer pieces are not kept


class Vocabulary:
    """Ranks of byte strings, from lines of base64 and rank."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.none = max(self.token) + 1  # stands where there is no token: between pieces, and where one was merged away
        self.length = np.zeros(self.none + 1, np.int64)
        self.length[-1] = -(1 << 40)
        for t, i in self.rank.items():
            self.length[i] = len(t)
        get = self.rank.get
        pairs = sorted((a << 32 | b, i) for t, i in self.rank.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None)
        self.codes, self.results = (np.array(x, np.int64) for x in zip(*pairs, (1 << 62, -1), strict=True))
        self.known: dict[str, bytes] = {}  # by piece

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what the pairs merge to; -1: no merge."""
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.results[at], -1)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Packed token ids of each piece."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(len(pieces)), size)
        place = np.arange(len(data)) + owner + 1  # a wall stands before and after each piece
        n = len(data) + len(pieces) + 1
        token, whose = np.full(n, self.none), np.zeros(n, np.int64)
        token[place], whose[place] = self.first[data], owner
        left, right, length = np.arange(-1, n - 1), np.arange(1, n + 1), self.length
        ranks = self.merged(token[:-1], token[1:])
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        cut = np.flatnonzero(np.diff(ranks[at])) + 1
        index = {int(ranks[x[0]]): x.tolist() for x in np.split(at, cut) if len(x)}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r, None)
            if found is None:
                continue
            p = np.array(found)
            p.sort()
            j = right[p]
            a, b = token[p], token[j]
            # what stands at a place never changes, so the pair is still there if the lengths add up
            stands = length[a] + length[b] == length[r]
            if not stands.all():
                p, j = p[stands], j[stands]
                if not len(p):
                    continue
            o = whose[p]
            if len(p) > 1 and (again := o[1:] == o[:-1]).any():  # one place of a piece at a time, the first one; a place entered twice falls out later
                rest = np.concatenate([[False], again])
                index[r] = p[rest].tolist()
                heapq.heappush(heap, r)
                p, j = p[~rest], j[~rest]
            token[p], token[j] = r, self.none
            k, h = right[j], left[p]
            right[p], left[k] = k, p
            both = np.concatenate([token[h], np.full(len(p), r)])
            q = self.merged(both, np.concatenate([both[len(p):], token[k]]))
            new = np.flatnonzero(q >= 0)
            for x, i in zip(q[new].tolist(), np.concatenate([h, p])[new].tolist(), strict=True):
                if (own := index.get(x)) is None:
                    index[x] = [i]
                    heapq.heappush(heap, x)
                else:
                    own.append(i)
        kept = token != self.none
        ids, ends = token[kept].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(np.bincount(whose[kept], minlength=len(pieces)))]) * 4
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids by piece, for at least these pieces."""
        known = self.known
        fresh = [p for p in pieces if p not in known]
        if fresh:
            if len(known) + len(fresh) > KNOWN_PIECES:
                known.clear()
                fresh = list(pieces)
            spelt = [p.encode() for p in fresh]
            hard = [k for k, p in enumerate(spelt) if p not in self.rank]
            found = [self.rank.get(p, 0).to_bytes(4, "little") for p in spelt]
            for k, ids in zip(hard, self.replay([spelt[k] for k in hard]) if hard else [], strict=True):
                found[k] = ids
            known.update(zip(fresh, found, strict=True))
        return known

    def encode_block(self, texts: list[str], split) -> list[bytes]:
        """Packed ids of each text.

        A piece that holds a space begins with it or is white space. So a text may be cut before each space and the
        runs matched apart, unless white space stands before a space: such texts are matched whole.
        """
        cut = [t.split(" ") for t in texts]
        seen = set().union(*[x[1:] for x in cut])
        spaced = {c for c in seen if not c or c[-1].isspace()}
        whole = {k: split(t) for k, t in enumerate(texts) if t and (cut[k][-1] == "" or len(cut[k]) > 1 and cut[k][0][-1:].isspace() or not spaced.isdisjoint(cut[k][1:-1]))}
        first = {k: split(x[0]) for k, x in enumerate(cut) if k not in whole}
        pieces = [split(" " + c) for c in seen]
        distinct = set().union(*pieces, *whole.values(), *first.values())
        ids = self.ids_of(distinct)
        get = ids.__getitem__
        run = {c: b"".join(map(get, x)) for c, x in zip(seen, pieces, strict=True)}.__getitem__
        out = [b"".join(map(get, whole[k])) if k in whole else b"".join([*map(get, first[k]), *map(run, x[1:])]) for k, x in enumerate(cut)]
        for p in [p for p in distinct if len(p) > LONG_PIECE]:
            ids.pop(p, None)
        return out


_MADE: dict[str, Vocabulary] = {}


def vocabulary(sent: tuple[str, Broadcast]) -> Vocabulary:
    """One copy per worker process, by the digest of its lines."""
    digest, lines = sent
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = Vocabulary(lines.value)
    return _MADE[digest]


def _sent(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The vocabulary's lines, read on the driver: executors need not have the file. Their size is the vocabulary's."""
    with open(path, "rb") as f:
        lines = f.read()
    return hashlib.sha256(lines).hexdigest(), spark.sparkContext.broadcast(lines)


def _encoded(batches, sent, pattern: str):
    voc, split = vocabulary(sent), regex.compile(pattern).findall
    gc.disable()  # many small objects, no cycles
    try:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy()
            at = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_BYTES)) + 1
            for lo, hi in zip([0, *at], [*at, len(b)], strict=True):
                ids = voc.encode_block([t or "" for t in b["text"].slice(lo, hi - lo).to_pylist()], split)
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].slice(lo, hi - lo), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})
    finally:  # the worker lives on for other stages
        voc.known.clear()
        gc.enable()
        memory.trim()


def _decoded(batches, sent):
    token = vocabulary(sent).token.__getitem__
    for b in batches:
        out = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in b["ids"]]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "n_tokens", "ids")), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])


CODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """docs' doc_id with n_tokens (long) and ids (binary, little-endian unsigned 32-bit integers).

    A null or empty text gives no ids; a repeated row is encoded again; there are no special tokens, their strings are
    ordinary text; a very long text is a block of its own; no rows give no rows; other columns are left out.
    """
    sent = _sent(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, sent, pattern), CODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded's doc_id, n_tokens and ids with decoded (binary): the bytes of the ids' tokens. Null ids decode to
    no bytes; an id outside the vocabulary is an error."""
    sent = _sent(encoded.sparkSession, path)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lambda batches: _decoded(batches, sent), CODED + ", decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """decode(encode(docs)) in one pass over the texts, in one Python worker for each task."""
    sent = _sent(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _decoded(_encoded(batches, sent, pattern), sent), CODED + ", decoded binary")
