"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (A-Z lowered, ASCII marks part words) and their beginnings of 5 to 7 bytes, so that inflected forms of a stem meet. The
vocabulary holds every term of the labelled examples; a text's other terms can meet no example and are left out of its vector. A term weighs
(1 + log count) x idf x relevance frequency: document frequencies are counted over all documents, and relevance
frequency, log2(2 + toxic / other examples with the term), lifts terms that lean to the toxic class without dropping any.

Examples stand in an inverted index. Lists of few postings are read whole. Common terms have a block of weights for each range of
examples, with the largest weight of each: a range is read only while its bound can lift one of its examples over the k-th best
cosine so far. Examples are numbered by their most frequent term, so that texts of a kind share ranges. The nearest examples
vote by cosine; a logistic curve, fitted to votes on examples that were left out in turn, calibrates.

At most POSITIVE_ROWS and NEGATIVE_ROWS labelled rows are used, those whose hashed ids come first in their class, and of these
as many as have SAMPLE_BYTES of text together (a single longer one is used).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import saved

POSITIVE_ROWS, NEGATIVE_ROWS = 1000, 2000
SAMPLE_BYTES = 32 << 20
NEIGHBOURS, RANGE, COMMON = 15, 256, 16  # examples of a range; a term is common if over one example in COMMON has it
BATCH = 64  # texts that are compared with the examples at once
THRESHOLD = 0.7
U = np.uint64
PREFIXES = range(5, 8)
SLOT_BITS = 22  # of a hash, which lead to its place in the vocabulary
IS_TERM = W.IS_WORD.copy()
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
    IS_TERM[_lo:_hi] = False


class Vocabulary:
    """Sorted distinct hashes and their places."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.slots = np.searchsorted(known, np.arange(1 << SLOT_BITS, dtype=U) << U(64 - SLOT_BITS)).astype(np.int32)

    def __reduce__(self):
        return Vocabulary, (self.known,)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and the places of those."""
        at = self.slots[(h >> U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        left, n = np.flatnonzero(at < len(self.known)), len(self.known)
        hit = np.zeros(len(h), bool)
        while len(left):  # a slot holds few hashes, in order
            found = self.known[at[left]]
            hit[left[found == h[left]]] = True
            left = left[found < h[left]]
            at[left] += 1
            left = left[at[left] < n]
        return hit, at[hit]


def terms(texts: list[bytes], vocabulary: Vocabulary | None = None):
    """(text, term, count) of the terms of each text, each term once, in order; of the known ones alone if a vocabulary is given,
    which are then named by place."""
    out = [[], [], []]
    for lo, hi in W.pieces(texts):
        b = W.Block(texts[lo:hi], IS_TERM, lower=True)
        size = b.end - b.start
        doc, h = [b.text_of], [b.hashes()]
        for k in PREFIXES:
            long = np.flatnonzero(size > k)
            doc.append(b.text_of[long])
            h.append(W.mix(b.part_hash(b.start[long], b.start[long] + k) + U(k)))
        doc, h = np.concatenate(doc), np.concatenate(h)
        if vocabulary is not None:
            hit, place = vocabulary.places(h)
            cell, count = np.unique(doc[hit] * max(1, len(vocabulary.known)) + place, return_counts=True)
            doc, h = np.divmod(cell, max(1, len(vocabulary.known)))
        else:
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            doc, h, count = doc[start], h[start], np.diff([*start, len(h)])
        for o, x in zip(out, (doc + lo, h, count), strict=True):
            o.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def spans(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from first to stop of each span, and the lengths."""
    n = stop - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class Index:
    """Examples by number: ids, labels, vote weights; postings by term and example; weights of common terms by range, and the largest of each."""

    vocabulary: Vocabulary
    term_weight: np.ndarray  # idf times relevance frequency
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    first: np.ndarray  # of each term's postings, and the end
    example: np.ndarray
    weight: np.ndarray
    common: np.ndarray  # row of each term below, or -1
    blocks: np.ndarray  # range x common term x example of the range
    bound: np.ndarray  # common term x range: the largest weight
    curve: tuple[float, float] = (1.0, 0.0)
    base: float = 0.0  # score of a text without terms
    neighbours: int = NEIGHBOURS

    def weights(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of (text, term, count), so that each text's vector has unit length."""
        w = (1 + np.log(count)) * self.term_weight[term]
        return w / np.sqrt(np.bincount(doc, weights=w * w))[doc] if len(w) else w

    def nearest(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, texts: int, without: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Numbers and cosines of the examples nearest to each text, nearest first, ties to the smaller number: exactly those of a full scan;
        and how many weights were read. without: a number that each text leaves out."""
        out, read, cut = [], 0, np.searchsorted(doc, np.arange(texts + 1))
        for lo in range(0, texts, BATCH):
            hi = min(texts, lo + BATCH)
            at = slice(cut[lo], cut[hi])
            got, n = self._nearest(doc[at] - lo, term[at], count[at], hi - lo, None if without is None else without[lo:hi])
            out += got
            read += n
        return out, read

    def _nearest(self, doc, term, count, m, without):
        q, size, k, n_ranges = self.weights(doc, term, count), len(self.ids), self.neighbours, len(self.blocks)
        row, width, mine = self.common[term], n_ranges * RANGE, np.arange(m)
        few = row < 0
        at, n = spans(self.first[term[few]], self.first[term[few] + 1])
        s, read = np.zeros(m * width), len(at)
        s += np.bincount(np.repeat(doc[few] * width, n) + self.example[at], weights=self.weight[at] * np.repeat(q[few], n), minlength=m * width)
        s = s.reshape(m, width)
        common = np.zeros((m, len(self.bound)))
        common[doc[~few], row[~few]] = q[~few]
        terms_of, limit, wait, step = (common > 0).sum(axis=1), common @ self.bound, np.ones((m, n_ranges), bool), 2
        while True:
            if without is not None:
                s[mine, without] = 0
            best = s.reshape(m, n_ranges, RANGE).max(axis=2) + limit if n_ranges else limit
            least = np.partition(s, width - k, axis=1)[:, width - k] if size > k else np.zeros(m)
            open_ = wait & (best >= least[:, None] - 1e-9) & (limit > 0)
            if not open_.any():
                break
            order = np.argsort(np.where(open_, -best, np.inf), axis=1, kind="stable")[:, :step]
            for r in np.unique(order):
                d = np.flatnonzero((order == r).any(axis=1) & open_[:, r])
                s[d, r * RANGE : (r + 1) * RANGE] += common[d] @ self.blocks[r]
                wait[d, r] = False
                read += int(terms_of[d].sum()) * RANGE
            step *= 4
        s = np.round(s[:, :size], 12)
        out = []
        for x in s:
            top = np.flatnonzero(x >= max(np.partition(x, size - k)[size - k] if size > k else 0.0, 1e-12))
            top = top[np.lexsort((top, -x[top]))[:k]]
            out.append((top, x[top]))
        return out, read

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        w = s * self.votes[e]
        return float((w @ self.labels[e]) / w.sum()) if len(e) else -1.0

    def score(self, vote: float) -> float:
        if vote < 0:
            return self.base
        z = np.log((vote + 0.01) / (1.01 - vote))
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * z + self.curve[1], -35, 35))))


def relevance(places: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """log2(2 + toxic / other) of each term: in so many examples of either class it stands, the other class counting as one at least."""
    a, b = (np.bincount(places[toxic == k], minlength=size) for k in (True, False))
    return np.log2(2 + a / np.maximum(1, b))


def build(rows: list[tuple[int, int, np.ndarray, np.ndarray]], known: np.ndarray, df: np.ndarray, n_docs: int, rates: tuple[float, float]) -> Index:
    """rows: id, label, terms' hashes, counts. known: the vocabulary, sorted. rates: labelled rows that one sampled row of each class stands for."""
    vocabulary = Vocabulary(known)
    blank, kept = [0.0, 0.0], []
    for i, y, h, c in rows:
        hit, place = vocabulary.places(h)
        if len(place):
            kept.append((h[hit][np.argmax(c[hit])], i, y, place, c[hit]))  # texts whose most frequent term is the same stand together
        else:
            blank[y] += rates[y]
    kept = [r[1:] for r in sorted(kept, key=lambda r: r[:2])]
    term = np.concatenate([r[2] for r in kept]) if kept else np.zeros(0, np.int64)
    many = np.array([len(r[2]) for r in kept], np.int64)
    labels, size = np.array([r[1] for r in kept], float), len(kept)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    ix = Index(vocabulary, idf * relevance(term, np.repeat(labels == 1, many), len(known)), np.array([r[0] for r in kept], np.int64), labels,
        np.array([rates[r[1]] for r in kept], float), *[np.zeros(0)] * 3, np.full(len(known), -1, np.int32), np.zeros((0, 0, RANGE)), np.zeros((0, 0)))
    ix.base = blank[1] / sum(blank) if sum(blank) else 0.0
    count, example = np.concatenate([r[3] for r in kept]) if kept else np.zeros(0, np.int64), np.repeat(np.arange(size), many)
    weight = ix.weights(example, term, count)
    vectors = example, term, count
    order = np.lexsort((example, term))
    term, ix.example, ix.weight = term[order], example[order], weight[order]
    ix.first = np.searchsorted(term, np.arange(len(known) + 1))
    often = np.flatnonzero(np.diff(ix.first) * COMMON > size) if size else np.zeros(0, np.int64)
    ix.common[often] = np.arange(len(often))
    at, n = spans(ix.first[often], ix.first[often + 1])
    ix.blocks = np.zeros((-(-size // RANGE), len(often), RANGE))
    ix.blocks[ix.example[at] // RANGE, np.repeat(np.arange(len(often)), n), ix.example[at] % RANGE] = ix.weight[at]
    ix.bound = ix.blocks.max(axis=2).T if size else np.zeros((0, 0))
    v = np.array([ix.vote(*x) for x in ix.nearest(*vectors, size, np.arange(size))[0]])
    on = v >= 0
    if on.any() and len(set(labels[on])) == 2:
        z, t, w = np.log((v[on] + 0.01) / (1.01 - v[on])), labels[on], ix.votes[on] / ix.votes[on].mean()
        a, c = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -35, 35)))
            g, s = w * (p - t), w * np.maximum(p * (1 - p), 1e-9)
            step = np.linalg.solve(np.array([[s @ (z * z) + 1e-2, s @ z], [s @ z, s.sum() + 1e-2]]), np.array([g @ z + 1e-2 * (a - 1), g.sum() + 1e-2 * c]))
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        ix.curve = (float(max(a, 1e-3)), float(c))
    return ix


PIECE = 1 << 16  # terms whose frequencies are added up together


def frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of docs each term stands, and the number of rows. A task sends one packed array for each PIECE of the vocabulary."""
    n_pieces = -(-len(known) // PIECE)
    sent = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the sample's text

    def count(batches):
        vocabulary, df, n = Vocabulary(sent.value), np.zeros(n_pieces * PIECE, np.int64), 0
        for b in batches:
            _, t, _ = terms(W.as_bytes(b["text"]), vocabulary)
            df += np.bincount(t, minlength=len(df))
            n += len(b)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([-1, *range(n_pieces)], pa.int32()), "n": pa.array([np.int64(n).tobytes(), *(x.tobytes() for x in df.reshape(n_pieces, PIECE))], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, np.int64) for x in group["n"].to_pylist()), np.int64(0))
        return pa.Table.from_arrays([group["piece"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["piece", "n"])

    got = docs.select("text").mapInArrow(count, "piece int, n binary").groupBy("piece").applyInArrow(add, "piece int, n binary").toArrow().sort_by("piece")
    parts = [np.frombuffer(x, np.int64) for x in got["n"].to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *parts[1:]])[: len(known)], int(parts[0][0]) if parts else 0


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", positive_rows: int = POSITIVE_ROWS, negative_rows: int = NEGATIVE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Index:
    """Index of labelled rows that satisfy `learn` (a condition on doc_id). Rows with a null label or id are left out; an id labelled
    twice counts once, with its larger label, and an id that several documents have stands for the first of their texts."""
    known = saved(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).where("_label in (0, 1)").collect()}
    of = lambda y, n: known.where(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = of(1, positive_rows).union(of(0, negative_rows))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by the two row counts
    texts = saved(found.groupBy("doc_id", "_label").agg(F.min("text").alias("text")))
    order = Window.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")  # over the sample alone
    used = texts.select("doc_id", (F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < sample_bytes).alias("_in")).where("_in")

    def extract(batches):
        for b in batches:
            doc, h, c = terms(W.as_bytes(b["text"]))
            cut = np.searchsorted(doc, np.arange(len(b) + 1))
            pairs = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "label": b["_label"],
                "terms": pa.array([h[i:j].tobytes() for i, j in pairs], pa.binary()), "counts": pa.array([c[i:j].astype(np.int32).tobytes() for i, j in pairs], pa.binary())})

    got = texts.join(F.broadcast(used), "doc_id", "left_semi").mapInArrow(extract, "doc_id long, label int, terms binary, counts binary").toArrow()  # bounded by sample_bytes
    rows = [(i, y, np.frombuffer(h, U), np.frombuffer(c, np.int32)) for i, y, h, c in zip(*(got[k].to_pylist() for k in ("doc_id", "label", "terms", "counts")), strict=True)]
    del got
    vocabulary = np.unique(np.concatenate([np.zeros(0, U), *(r[2] for r in rows)]))
    df, n_docs = frequencies(docs, vocabulary)
    sizes = [max(1, sum(r[1] == k for r in rows)) for k in (0, 1)]
    return build(rows, vocabulary, df.astype(float), n_docs, tuple(max(1.0, totals.get(k, 0) / sizes[k]) for k in (0, 1)))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score (0 to 1) and evidence (array of struct(doc_id, cosine, label): the nearest examples).

    A null or empty text and one without a term of any example have no evidence and the share of toxic among examples without terms. A text of
    any length is one vector of its distinct terms. Repeated rows are scored alike; ids, null ones too, are passed on and not looked at; no rows give no rows; other
    columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample's text

    def run(batches):
        ix = sent.value
        for b in batches:
            near, _ = ix.nearest(*terms(W.as_bytes(b["text"]), ix.vocabulary), len(b))
            scores, size = [ix.score(ix.vote(e, s)) for e, s in near], [len(e) for e, _ in near]
            e, s = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64), np.zeros(0))
            hits = pa.StructArray.from_arrays([pa.array(ix.ids[e]), pa.array(s), pa.array(ix.labels[e].astype(np.int32))], ["doc_id", "cosine", "label"])
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(scores, pa.float64()), "evidence": pa.ListArray.from_arrays(pa.array([0, *np.cumsum(size)], pa.int32()), hits)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")
