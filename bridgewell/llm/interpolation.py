"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | h) is a mixture of c(h w)/c(h), c(w)/N and 1/(V+1), with weights by the bucket (power of two) of the
context's count c(h). The weights come from expectation-maximisation over held-out counts: one training document
in `dev_modulus` is deleted from the counts that predict it. Counts cover every training document.

Blocks of documents send their distinct n-grams, packed, to buckets of the hash space, which add them up and send back
the totals in the same order; a block then looks its tokens up by place. Only sums and a histogram of bounded
size reach the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import checkpoint_folder

U = np.uint64
END = W.mix(np.array([1 << 60], U))[0]  # the token after a document's words
DEV_MODULUS = 50
CONTEXTS = 40  # buckets of context counts: 0 for none, else one for each power of two
BINS, PER_DECADE = 200, 10  # of log10 estimates, for the weights alone


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, read again."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/bridgewell-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes, so that leading zero bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, U), dtype=U)


class _Tokens:
    """Tokens and bigrams of the documents of a block, in order."""

    def __init__(self, texts: list[bytes]):
        tokens, docs = [], []
        for lo, hi in W.pieces(texts):
            b = W.Block(texts[lo:hi], lower=True)
            t = np.full(len(b.start) + hi - lo, END, U)
            t[np.arange(len(b.start)) + b.text_of] = b.hashes()
            tokens.append(t)
            docs.append(np.repeat(np.arange(lo, hi), np.diff(b.first) + 1))
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, U)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        # before the first token of a document stands the end of another, which is counted as often as documents begin
        self.before = np.concatenate([[END], self.token[:-1]]).astype(U) if len(self.token) else self.token
        self.pair = W.mix(W.mix(self.before + U(99)) + self.token)


def _sizes(n: int, group: pa.Table, flags: tuple[str, ...]):
    """Per n-gram size: distinct hashes, the place of each token's, and counts by flag."""
    t = _Tokens(W.as_bytes(group["text"]))
    marks = [group[f].to_numpy(zero_copy_only=False).astype(bool)[t.doc] for f in flags]
    for k, grams in enumerate((t.pair, t.token)):
        values, where = np.unique(grams, return_inverse=True)
        yield k, values, where, [np.bincount(where[m], minlength=len(values)).astype(np.uint64) for m in marks]


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [c for c, _ in schema])


def _context(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else the place of log10 p from the top."""
    return np.where(p > 0, np.clip((-np.log10(np.maximum(p, 1e-300)) * PER_DECADE).astype(np.int64) + 1, 1, BINS - 1), 0)


def mixture(histogram: np.ndarray, types: int, rounds: int = 50) -> np.ndarray:
    """Weights (context bucket, [bigram, unigram, uniform]) by expectation-maximisation.

    histogram: rows of context bucket, bin of the bigram estimate, bin of the unigram estimate, held-out count. A bucket
    without held-out tokens takes the weights of all buckets together; no weight falls below 1e-6.
    """
    value = np.concatenate([[0.0], 10.0 ** (-(np.arange(BINS - 1) + 0.5) / PER_DECADE)])

    def learn(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = np.stack([np.minimum(value[rows[:, 1]], 1), np.minimum(value[rows[:, 2]], 1), np.full(len(rows), 1 / (types + 1))], axis=1)
        for _ in range(rounds):
            part = p * w
            w = (part / part.sum(axis=1, keepdims=True) * rows[:, 3:]).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    start = np.array([0.4, 0.5, 0.1])
    every = learn(histogram, start) if len(histogram) else start
    out = np.tile(every, (CONTEXTS, 1))
    for c in range(CONTEXTS):
        if len(rows := histogram[histogram[:, 0] == c]):
            out[c] = learn(rows, every)
    out[0, 0] = 0.0  # an unseen context says nothing
    out[0] /= out[0].sum()
    return out


def score(docs: DataFrame, learn: Column, dev_modulus: int = DEV_MODULUS, blocks: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens (long), base_score and score (double, log10 probabilities).

    A null or repeated doc_id is passed on: it has no part in the counts; a text of any length is scored whole. The weights alone rest on estimates in bins of a tenth of
    a decade (BINS). learn: whether a row is training text (null: not). Tokens: words with A-Z lowered, then one end for each text; a null or empty
    text is one end. base_score: add-one unigram. Repeated rows count each; without training rows every token is
    unknown and has the uniform share. No rows give no rows; other columns are left out.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    n = blocks or W.block_count(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = slim.withColumn("dev", F.col("train") & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(dev_modulus)) == 0)).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))  # null and repeated ids are spread by their texts

    def send(key: tuple, group: pa.Table) -> pa.Table:
        rows, block = [], key[0].as_py()
        for k, values, _, (train, dev) in _sizes(n, group, ("train", "dev")):
            edge = W.buckets(values, n)
            rows += [(k * n + q, block, _pack_sorted(values[i:j]), _pack(train[i:j]), _pack(dev[i:j])) for q, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
        return _table(rows, [("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unpack_sorted(x) for x in group["hashes"].to_pylist()]
        train, dev = ([_unpack(x, np.uint64) for x in group[c].to_pylist()] for c in ("train", "dev"))
        values, where = np.unique(np.concatenate(parts), return_inverse=True)
        total, gone = (np.bincount(where, weights=np.concatenate(x), minlength=len(values)).astype(np.uint64) for x in (train, dev))
        rows, at = [], 0
        for k, block in enumerate(group["block"].to_pylist()):
            own = where[at : at + len(parts[k])]
            at += len(own)
            rows.append((0, block, bucket, _pack(total[own]), None, None, None, None, None))
            if (d := dev[k] > 0).any():
                rows.append((1, block, bucket, _pack(total[own][d]), _pack(gone[own][d]), _pack_sorted(parts[k][d]), None, None, None))
        if bucket >= n:
            rows.append((2, -1, bucket, None, None, None, int(total.sum(dtype=np.int64)), int((total > 0).sum()), int(gone.sum(dtype=np.int64))))
        return _table(rows, [("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("deleted", pa.binary()), ("hashes", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("dev_tokens", pa.int64())])

    sent = dealt.groupBy("block").applyInArrow(send, "bucket int, block int, hashes binary, train binary, dev binary")
    counts = written(sent.groupBy("bucket").applyInArrow(add, "kind int, block int, bucket int, counts binary, deleted binary, hashes binary, tokens long, types long, dev_tokens long"))
    sums = counts.where("kind = 2").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "dev_tokens")]).first()
    total, types, dev_total = (int(x) for x in sums)

    def look(group: pa.Table, came: pa.Table) -> pa.Table:
        schema = [(c, pa.int64()) for c in ("context", "bigram", "unigram", "tokens")]
        if not len(group):
            return _table([], schema)
        t = _Tokens(W.as_bytes(group["text"]))
        came = came.sort_by("bucket")
        side = came["bucket"].to_numpy() >= n
        hashes, got, gone = ([x for x in came[c].to_pylist()] for c in ("hashes", "counts", "deleted"))

        def left(grams: np.ndarray, unigrams: bool) -> np.ndarray:
            own = [k for k in range(len(side)) if side[k] == unigrams]
            h = np.concatenate([_unpack_sorted(hashes[k]) for k in own])
            c = np.concatenate([_unpack(got[k], np.uint64).astype(np.int64) - _unpack(gone[k], np.uint64).astype(np.int64) for k in own])
            return c[np.searchsorted(h, grams)]

        two, one, before = left(t.pair, False), left(t.token, True), left(t.before, True)
        cell = (_context(before) * BINS + _bin(two / np.maximum(before, 1))) * BINS + _bin(one / max(1, total - dev_total))
        cells, many = np.unique(cell, return_counts=True)
        return pa.Table.from_arrays([pa.array(x) for x in (cells // (BINS * BINS), cells // BINS % BINS, cells % BINS, many)], [c for c, _ in schema])

    held = dealt.where("dev").select("block", "text").groupBy("block").cogroup(counts.where("kind = 1").select("block", "bucket", "counts", "deleted", "hashes").groupBy("block")).applyInArrow(
        look, "context long, bigram long, unigram long, tokens long")
    histogram = held.groupBy("context", "bigram", "unigram").agg(F.sum("tokens")).collect()  # at most CONTEXTS x BINS x BINS cells
    weights = mixture(np.array([tuple(r) for r in histogram], np.int64).reshape(-1, 4), types)

    def judge(group: pa.Table, came: pa.Table) -> pa.Table:
        came = came.sort_by("bucket")
        side, packed = came["bucket"].to_numpy() >= n, came["counts"].to_pylist()
        t = _Tokens(W.as_bytes(group["text"]))

        def find(grams: np.ndarray, unigrams: bool) -> tuple[np.ndarray, np.ndarray]:
            c = np.concatenate([_unpack(packed[k], np.uint64) for k in range(len(side)) if side[k] == unigrams]).astype(np.int64)
            values, where = np.unique(grams, return_inverse=True)
            if len(values) != len(c):
                raise RuntimeError("the documents changed while they were scored")
            return c, where

        c, where = find(t.token, True)
        one = c[where]
        at_end = c[where[t.token == END][0]]
        before = np.concatenate([[at_end], one[:-1]])
        c, where = find(t.pair, False)
        w = weights[_context(before)]
        p = w[:, 0] * c[where] / np.maximum(before, 1) + w[:, 1] * one / max(1, total) + w[:, 2] / (types + 1)
        base = np.log10((one + 1) / (total + types + 1))
        docs_here = len(group)
        sums = [np.bincount(t.doc, weights=x, minlength=docs_here) for x in (np.ones(len(one)), one > 0, base, np.log10(p))]
        return pa.Table.from_arrays(
            [group["doc_id"], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(docs_here, total)), pa.array(sums[2]), pa.array(sums[3])],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.select("doc_id", "text", "block").groupBy("block").cogroup(counts.where("kind = 0").select("block", "bucket", "counts").groupBy("block")).applyInArrow(
        judge, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
