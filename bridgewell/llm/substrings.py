"""Substring dedup: removal of long word runs that an earlier document holds, by difference-cover anchors.

A window is `length` consecutive words. Positions of a document whose remainder modulo `period` lies in a
difference cover are anchors; for any two equal windows some shift below the period puts both on anchors, so
they share the hash of `length - period + 1` words there. Anchors held by two documents are found first; around them
alone the matches are extended: whole windows are hashed with 128 bits and the earliest document of each is found.

Texts are dealt once into blocks by document, and blocks exchange packed arrays of distinct hashes with
buckets of the hash space; a hash that every document holds costs one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory
from . import words as W

LENGTH, PERIOD = 50, 31
#: A perfect difference cover modulo 31: every remainder is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
U = np.uint64


def cover_of(period: int) -> np.ndarray:
    """Whether each remainder is in the cover: the known one for 31, else low ones and multiples of a step."""
    inside = np.zeros(period, bool)
    if period == PERIOD:
        inside[list(COVER)] = True
    else:
        step = max(1, int(period**0.5))
        inside[:step] = True
        inside[::step] = True
    return inside


class _Part:
    """Words of some documents of a block, with the tests that the stages share."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int, period: int):
        self.block = W.Block(texts)
        self.length, self.period = length, period
        b = self.block
        self.counts = np.diff(b.first)
        self.place = np.arange(len(b.start)) - b.first[b.text_of]
        self.left = self.counts[b.text_of] - self.place  # words from here to the end of the document
        self.ids = ids[b.text_of]
        self.words = b.hashes()
        self.windows = W.Windows(self.words)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes."""
        n = self.length - self.period + 1
        long_enough = self.counts[self.block.text_of] >= self.length
        at = np.flatnonzero(cover_of(self.period)[self.place % self.period] & (self.left >= n) & long_enough)
        return at, self.windows.at(at, n)

    def around(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of these places."""
        reach = np.minimum(self.place[at], self.period - 1)
        return np.flatnonzero(_covered(at - reach, at + 1, len(self.words)) & (self.left >= self.length))

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "other"):
            self.other = W.Windows(self.block.hashes(1), W.OTHER_POWERS)  # of other word hashes, so that both halves are independent
        return self.windows.at(at, self.length), self.other.at(at, self.length)


def _parts(group: pa.Table, length: int, period: int):
    texts, ids = W.as_bytes(group["text"]), group["doc_id"].to_numpy()
    for lo, hi in W.pieces(texts):
        yield lo, hi, _Part(texts[lo:hi], ids[lo:hi], length, period)


def _packed(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _arrays(column, kind=U) -> np.ndarray:
    """The packed arrays of a column, one after another."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def dedup(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, blocks: int | None = None, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_words (long), n_removed (long), text (the kept words, one space between) and removed (array of
    struct(start, stop), word offsets of removed runs).

    A word goes if a window over it also starts in a document of smaller doc_id; windows are judged on the input.
    A null or empty text has no words and is returned empty. Rows with the same doc_id are judged alike, each on its
    own: neither takes words from the other. A null doc_id stands before all others. Documents shorter than a window lose nothing. No rows give no rows. The columns
    named in carry come along as they are, under names of their own; others are left out.
    """
    if not 1 <= period <= length:
        raise ValueError("the period must lie between 1 and the length")
    slim = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    n = blocks or W.block_count(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))  # null and repeated ids are spread by their texts

    def send_anchors(key: tuple, group: pa.Table) -> pa.Table:
        found = []
        for _, _, part in _parts(group, length, period):
            at, h = part.anchors()
            found.append((h, part.ids[at]))
        h, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = (np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)) if len(h) else np.zeros(0, bool)
        h = h[first]
        edge = W.buckets(h, n)
        block = key[0].as_py()
        rows = [(k, block, h[i:j].tobytes(), several[i:j].tobytes()) for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
        return _packed(rows, ["bucket", "block", "hashes", "several"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def shared_anchors(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U) for x in group["hashes"].to_pylist()]
        values, where, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        count[where[_arrays(group["several"], bool)]] += 1
        rows, at = [], 0
        for block, part in zip(group["block"].to_pylist(), parts, strict=True):
            both = part[count[where[at : at + len(part)]] > 1]
            at += len(part)
            if len(both):
                rows.append((block, both.tobytes()))
        return _packed(rows, ["block", "hashes"], [pa.int32(), pa.binary()])

    def send_windows(key: tuple, group: pa.Table, shared: pa.Table) -> pa.Table:
        known = np.sort(_arrays(shared["hashes"]))
        found = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))]
        for _, _, part in _parts(group, length, period) if len(known) else ():
            at, h = part.anchors()
            at = part.around(at[_among(h, known)])
            found.append((*part.whole(at), part.ids[at]))
        a, b, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b, least, most = _by_window(a, b, ids, ids)
        edge, block = W.buckets(a, n), key[0].as_py()
        rows = [(k, block, *(x[i:j].tobytes() for x in (a, b, least, most))) for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
        return _packed(rows, ["bucket", "block", "a", "b", "least", "most"], [pa.int32(), pa.int32(), *[pa.binary()] * 4])

    def first_documents(group: pa.Table) -> pa.Table:
        parts = [[np.frombuffer(x, t) for x in group[c].to_pylist()] for c, t in (("a", U), ("b", U), ("least", np.int64), ("most", np.int64))]
        a, b, least, most = (np.concatenate(x) for x in parts)
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        start = np.flatnonzero(new)
        over = np.empty(len(a), np.int64)
        over[order] = np.repeat(np.minimum.reduceat(least[order], start), np.diff([*start, len(a)]))
        rows, at = [], 0
        for k, block in enumerate(group["block"].to_pylist()):
            size = len(parts[0][k])
            m = over[at : at + size]
            late = parts[3][k] > m
            at += size
            if late.any():
                rows.append((block, parts[0][k][late].tobytes(), parts[1][k][late].tobytes(), m[late].tobytes()))
        return _packed(rows, ["block", "a", "b", "first"], [pa.int32(), *[pa.binary()] * 3])

    def cut(group: pa.Table, late: pa.Table) -> pa.Table:
        a, b, first = _arrays(late["a"]), _arrays(late["b"]), _arrays(late["first"], np.int64)
        order = np.lexsort((b, a))
        a, b, first = a[order], b[order], first[order]
        out = []
        for lo, hi, part in _parts(group, length, period):
            at = np.zeros(0, np.int64)
            if len(a):
                at = np.flatnonzero(part.left >= length)
                h, other = part.whole(at)
                k = np.searchsorted(a, h)
                hit = k < len(a)
                hit[hit] = a[k[hit]] == h[hit]
                at, h, other, k = at[hit], h[hit], other[hit], k[hit]
                while True:  # steps over windows that agree in the first half of the hash alone
                    wrong = (b[k] != other) & (k + 1 < len(a)) & (a[np.minimum(k + 1, len(a) - 1)] == h)
                    if not wrong.any():
                        break
                    k = k + wrong
                at = at[(b[k] == other) & (first[k] < part.ids[at])]
            removed = _covered(at, at + length, len(part.words))
            data, start, end = part.block.data, part.block.start, part.block.end
            for i in range(hi - lo):
                f, t = part.block.first[i], part.block.first[i + 1]
                r = removed[f:t]
                keep = ~r
                text = b" ".join([data[x:y] for x, y in zip(start[f:t][keep].tolist(), end[f:t][keep].tolist(), strict=True)])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
                out.append((t - f, int(r.sum()), text.decode(), [{"start": int(x), "stop": int(y)} for x, y in zip(edges[0::2], edges[1::2], strict=True)]))
        memory.trim()
        cols = list(zip(*out, strict=True))
        ids = pa.array([None if z else x for x, z in zip(group["doc_id"].to_pylist(), group["no_id"].to_pylist(), strict=True)], pa.int64())
        came = [group[f"carry_{i}"] for i in range(len(kinds))]
        return pa.Table.from_arrays(
            [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), *came],
            ["doc_id", "n_words", "n_removed", "text", "removed", *(f"carry_{i}" for i in range(len(kinds)))])

    def with_windows(key, group, shared):
        return send_windows(key, group, shared) if len(group) else _packed([], ["bucket", "block", "a", "b", "least", "most"], [pa.int32(), pa.int32(), *[pa.binary()] * 4])

    anchors = dealt.groupBy("block").applyInArrow(send_anchors, "bucket int, block int, hashes binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "block int, hashes binary")
    windows = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(with_windows, "bucket int, block int, a binary, b binary, least binary, most binary")
    late = windows.groupBy("bucket").applyInArrow(first_documents, "block int, a binary, b binary, first binary")
    schema = "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:int,stop:int>>" + "".join(f", carry_{i} {k}" for i, k in enumerate(kinds))
    out = dealt.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(cut, schema)
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(stop, minlength=n + 1)[:n]) > 0


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    k = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[k] == values


def _by_window(a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray):
    """One entry for each window, in the order of its hash, with its smallest and largest document."""
    if not len(a):
        return a, b, least, most
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[start], b[start], np.minimum.reduceat(least[order], start), np.maximum.reduceat(most[order], start)


def kept(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs where words were removed hold the kept words in `text` and their length in `n_chars`; other rows stand
    as they are. The columns and the number of rows stay."""
    own = {f"_{i}": c for i, c in enumerate(docs.columns) if c != "doc_id"}
    found = dedup(docs.select("doc_id", "text", *[F.col(c).alias(k) for k, c in own.items()]), length, carry=list(own))
    name = {c: k for k, c in own.items()}
    fewer = F.col("n_removed") > 0
    new = {name["text"]: F.when(fewer, F.col("text")).otherwise(F.col(name["text"]))}
    if "n_chars" in name:
        new[name["n_chars"]] = F.when(fewer, F.length("text")).otherwise(F.col(name["n_chars"]))
    out = found.withColumns(new)
    return out.select(*["doc_id" if c == "doc_id" else F.col(name[c]).alias(c) for c in docs.columns])
