"""A text encoder learned from the texts: TF-IDF rows projected on their leading right singular vectors.

Texts are split for the document frequencies and once more to be coded; rounds read the saved codes of terms and their counts.

The vectors are found by subspace iteration from a random start (a randomised range finder with power iterations): each round multiplies the terms' Gram matrix, summed
over all texts in their tasks, with an orthonormal basis of a few dozen columns. Only matrices of terms by columns, whose size the vocabulary's bound sets, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .products import add_up, arrays
from .storage import saved

DIMS, TERMS, ROUNDS, EXTRA = 64, 1 << 15, 3, 10  # of an embedding; most terms; passes over the texts; columns beyond the wanted ones
ENTRIES = 1 << 12  # matrix entries multiplied at once: with so few columns they stay in a core's cache


@dataclass
class Encoder:
    terms: list[str]
    idf: np.ndarray
    basis: np.ndarray  # terms x dims, in order of falling singular values
    singular: np.ndarray

    def counts(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of the known terms, rows in order."""
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        code = pc.index_in(words.flatten(), value_set=pa.array(self.terms, pa.string()))
        hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        pairs, count = np.unique(np.repeat(np.arange(len(n)), n)[hit] * max(1, len(self.terms)) + code.fill_null(0).to_numpy()[hit].astype(np.int64), return_counts=True)
        return *np.divmod(pairs, max(1, len(self.terms))), count

    def entries(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and value of the TF-IDF matrix, rows in order."""
        row, term, count = self.counts(words)
        return row, term, _values(self.idf, row, term, count)


def _values(idf: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1 + ln(count) times idf, rows at unit length."""
    value = (1 + np.log(count)) * idf[term]
    return value / np.sqrt(np.bincount(row, weights=value**2))[row]


def _rows(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The matrix (n rows) times the basis, some entries at a time."""
    out = np.zeros((n, basis.shape[1]))
    for lo in range(0, len(row), ENTRIES):
        r, t, v = (x[lo : lo + ENTRIES] for x in (row, term, value))
        start = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[start]] += np.add.reduceat(basis[t] * v[:, None], start)
    return out


def _coded(words: DataFrame, model: Encoder) -> DataFrame:
    """term and count of each text's known terms, as arrays."""
    sent = words.sparkSession.sparkContext.broadcast(model)  # TERMS words

    def run(batches):
        m = sent.value
        for b in batches:
            row, term, count = m.counts(b["w"])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(b)))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, count)], ["term", "count"])

    return words.mapInArrow(run, "term array<int>, count array<int>")


def _gram(coded: DataFrame, sent, shape: tuple[int, int]) -> np.ndarray:
    """Transposed matrix times matrix times basis, over all texts."""

    def run(batches):
        idf, basis = sent.value
        total = np.zeros(basis.shape)
        for b in batches:
            row = np.repeat(np.arange(len(b)), pc.list_value_length(b["term"]).to_numpy())
            term, count = (b[c].flatten().to_numpy() for c in ("term", "count"))
            value = _values(idf, row, term, count)
            here = _rows(row, term, value, len(b), basis)
            order = np.argsort(term, kind="stable")
            for lo in range(0, len(order), ENTRIES):
                at = order[lo : lo + ENTRIES]
                start = np.flatnonzero(np.diff(term[at], prepend=-1))
                total[term[at][start]] += np.add.reduceat(here[row[at]] * value[at][:, None], start)
        own = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(own), 4096):
            part = own[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), arrays(total[part])], ["node", "v"])

    out, got = np.zeros(shape), add_up(coded.mapInArrow(run, "node long, v array<double>")).toArrow()
    if len(got):
        out[got["node"].to_numpy()] = got["v"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)
    return out


def fit(texts: DataFrame, dims: int = DIMS, most_terms: int = TERMS, rounds: int = ROUNDS, extra: int = EXTRA, seed: int = 7, text: str = "text") -> Encoder:
    """Learned from every row of texts (null: empty). Terms are lower-cased words that two texts have, the most frequent ones up to most_terms."""
    words = texts.select(F.coalesce(tokens(F.lower(text)), F.array().cast("array<string>")).alias("w"))
    n = words.count()
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    known = df.orderBy(F.desc("df"), "term").limit(most_terms).toArrow()
    model = Encoder(known["term"].to_pylist(), np.log((1 + n) / (1 + known["df"].to_numpy())) + 1, np.zeros((len(known), dims)), np.zeros(dims))
    columns = min(len(known), dims + extra)
    if not columns:
        return model
    coded = saved(_coded(words, model))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(known), columns)))[0]
    for r in range(rounds):
        sent = texts.sparkSession.sparkContext.broadcast((model.idf, basis))  # terms by columns
        gram = _gram(coded, sent, basis.shape)
        sent.unpersist()
        if r + 1 < rounds:
            basis = np.linalg.qr(gram)[0]
    values, turn = np.linalg.eigh(basis.T @ gram)
    order = np.argsort(-values)[:dims]
    vectors = basis @ turn[:, order]
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0) < 0, -1, 1)  # one sign for each
    model.basis[:, : len(order)], model.singular[: len(order)] = vectors, np.sqrt(np.maximum(values[order], 0))
    return model


def encode(texts: DataFrame, model: Encoder, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and v of each row: the text's TF-IDF row in the learned space, at unit length; zeros for a null text or one without known terms."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # TERMS by DIMS numbers

    def run(batches):
        m = sent.value
        for b in batches:
            x = _rows(*m.entries(b["w"]), len(b), m.basis)
            length = np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([b[key], arrays(np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12))], [key, "v"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(tokens(F.lower(text)), F.array().cast("array<string>")).alias("w")).mapInArrow(run, f"{key} {kind}, v array<double>")


def encode_once(texts: DataFrame, model: Encoder, key: str = "item_id", text: str = "text") -> DataFrame:
    """As encode(), but each distinct text is encoded once, whatever the number of its rows; a null text counts as empty."""
    marked = texts.select(key, F.coalesce(text, F.lit("")).alias(text)).withColumn("_id", F.sha2(text, 256))
    once = encode(marked.groupBy("_id").agg(F.first(text).alias(text)), model, "_id", text)
    return marked.select(key, "_id").join(once, "_id").select(key, "v")
