"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: byte 3-grams, and 1- to 3-grams over word shapes (letter case, symbols at the
end, same word as before), hashed to 2**18 ids. Indicators are scaled by the log-count ratios of the classes and
to unit length; a linear hinge-loss model is fitted to them by dual coordinate descent; a logistic curve turns margins into scores.

The model is fitted on at most `sample_rows` labelled rows, those whose hashed ids come first, and of these on as many as have
`sample_bytes` of features together, four a feature (a single longer one is used); every text is scored whole. Label 1 is good quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .interpolation import written

BITS = 18
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 192 << 20
THRESHOLD = 0.3
#: Character classes of word shapes: 1 lower-case or other letter, 2 upper-case letter, 3 digit, 4 stop or comma, 5 other mark.
CLASSES = np.full(256, 1, np.int64)
CLASSES[65:91] = 2
CLASSES[48:58] = 3
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
    CLASSES[_lo:_hi] = 5
CLASSES[[44, 46, 63]] = 4


def _distinct(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct ids, by writing each one's place and keeping those whose place stands."""
    at = np.arange(len(ids), dtype=np.int32)
    seen[ids] = at
    return ids[seen[ids] == at]


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct feature ids of each text. An empty text has none."""
    out, seen, shift = [], np.zeros(1 << BITS, np.int32), W.U(64 - BITS)
    for lo, hi in W.pieces(texts):
        part = texts[lo:hi]
        b = W.Block(part)
        a = b.bytes.astype(np.uint64)
        grams = ((a[:-2] | (a[1:-1] << W.U(8)) | (a[2:] << W.U(16))) + W.U(1)) * W.U(0x9E3779B97F4A7C15) >> shift
        h = b.hashes()
        if len(h):
            kind = CLASSES[b.bytes]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (b.text_of[1:] == b.text_of[:-1])])
            last, before = kind[b.end - 1], kind[np.maximum(b.end - 2, b.start)]
            shape = kind[b.start] + 6 * (kind[np.minimum(b.start + 1, b.end - 1)] + 6 * (before + 6 * (last + 6 * (same + 2 * (b.end - b.start == 1)))))
            s = shape.astype(W.U) + W.U(1)
            two = np.concatenate([[0], s[:-1]]).astype(W.U)
            three = np.concatenate([[0, 0], s[:-2]]).astype(W.U)[: len(s)]
            place = np.arange(len(s)) - b.first[b.text_of]
            two[place < 1] = 0
            three[place < 2] = 0
            shapes = np.stack([W.mix(s + W.U(7 << 40)), W.mix(s + (two << W.U(14)) + W.U(1 << 44)), W.mix(s + (two << W.U(14)) + (three << W.U(28)) + W.U(1 << 45))]) >> shift
        at = np.cumsum([1, *(len(t) + 1 for t in part)])
        for k, t in enumerate(part):
            if b.first[k] == b.first[k + 1]:
                out.append(np.zeros(0, np.int32))
                continue
            g = grams[at[k] - 1 : at[k] + len(t) - 1]
            ids = np.concatenate([g, shapes[:, b.first[k] : b.first[k + 1]].ravel()]).astype(np.int32)
            out.append(_distinct(ids, seen))
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each feature, log-count ratio included
    ratio: np.ndarray
    slope: float
    offset: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """The bias stands at the end of the weights."""
        return np.array([self.weights[r].sum() / max(1e-12, np.sqrt((self.ratio[r] ** 2).sum())) + self.weights[-1] if len(r) else self.weights[-1] for r in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.offset, -35, 35)))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; the last weight is the bias."""
    w, alpha, rng = np.zeros(n + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([v @ v + 1 for v in values])
    weight = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), weight[i])
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * values[i]
                w[-1] += d * y[i]
                alpha[i], most = new, max(most, abs(d))
        if most < 1e-4:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """Every fifth row is kept back for the logistic curve. No rows, or one class alone, give a constant score."""
    n = 1 << BITS
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(n + 1), np.ones(n), 0.0, 0.0 if not len(labels) else 3.0 * y[0])
    good, bad = np.ones(n), np.ones(n)
    back = np.arange(len(rows)) % 5 == 4
    for r, v, b in zip(rows, y, back, strict=True):
        if not b:
            (good if v > 0 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    values = [(x := ratio[r]) / max(1e-12, np.sqrt(x @ x)) for r in rows]
    own = np.flatnonzero(~back)
    w = _descend([rows[i] for i in own], [values[i] for i in own], y[own], n, cost, epochs, seed)
    model = Model(np.concatenate([w[:-1] * ratio, w[-1:]]), ratio, 1.0, 0.0)
    held = np.flatnonzero(back) if len({*y[back]}) == 2 else np.arange(len(rows))
    m, t = model.margins([rows[i] for i in held]), (y[held] > 0) * 1.0
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, c = 1.0, 0.0
    for _ in range(60):  # Newton steps on the log loss, lightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -35, 35)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[s @ (m * m) + 1e-3, s @ m], [s @ m, s.sum() + 1e-3]]), np.array([g @ m + 1e-3 * a, g.sum()]))
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(a), float(c)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on the labelled rows that satisfy `learn` (a condition on doc_id), at most sample_rows of them and sample_bytes of their features.

    Rows with a null label or id are left out; an id labelled twice counts once, with its
    smaller label, and an id that several documents have stands for the first of their texts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by sample_rows
    texts = found.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))

    def extract(batches):
        for b in batches:
            rows = features(W.as_bytes(b["text"]))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "label": b["_label"], "ids": pa.array([r.tobytes() for r in rows], pa.binary())})

    drawn = written(texts.mapInArrow(extract, "doc_id long, label int, ids binary"))
    order = Window.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over the sample alone
    used = drawn.select("doc_id", (F.coalesce(F.sum(F.octet_length("ids")).over(order), F.lit(0)) < sample_bytes).alias("_in")).where("_in")
    got = drawn.join(F.broadcast(used), "doc_id", "left_semi").toArrow()  # bounded by sample_bytes
    got = got.sort_by("doc_id")
    rows = [np.frombuffer(x, np.int32) for x in got["ids"].to_pylist()]
    return fit(rows, np.array(got["label"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs, 0 to 1. A null text counts as empty; empty texts get the score of a
    text without features; repeated rows are scored alike; ids are not looked at; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, by BITS

    def run(batches):
        for b in batches:
            s = sent.value.scores(features(W.as_bytes(b["text"])))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(s, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, by BITS

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.scores(features(W.as_bytes(b["text"]))) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learns(modulus: int, rest: int) -> Column:
    """True for rows outside the held-out remainder of the id's checksum."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != rest
