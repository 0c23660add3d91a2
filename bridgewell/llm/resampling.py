"""Importance resampling towards a target distribution, over hashed n-gram features.

A feature is a run of 1 to max_n consecutive words; its bucket is a checksum of its bytes. Buckets are counted over all documents and over all
target texts, the log ratio of the two smoothed shares is the bucket's gain, and a document weighs the sum of the gains of its features. Random numbers made from
ids (the Gumbel top-k trick) turn weights into a draw without replacement.

Within a task about a megabyte of text at a time is interned in an open-addressed table with a slot for each distinct n-gram, which holds its
bucket and its count; documents gather gains by the slots of their occurrences. What leaves a task is one sum for each bucket, or slim rows. Ranks
come from a sort by ranges whose sizes are added up, so that no task holds the order of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import saved
from .interpolation import written

MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
IS_TERM = np.zeros(256, bool)  # bytes of words: ASCII letters and digits, and all beyond ASCII
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


class _Grams:
    """The n-grams of some texts, interned: place (slot of each occurrence) and text_of by occurrence, bucket and count by slot."""

    def __init__(self, texts: list[bytes], max_n: int, buckets: int):
        b = W.Block(texts, IS_TERM, lower=True)
        self.n_words = np.diff(b.first)
        size = b.end - b.start
        if max_n == 1:
            data, start, end, self.text_of = b.bytes, b.start, b.end, b.text_of
        else:  # the words one space apart, so that an n-gram is one range
            ends = np.cumsum(size + 1)
            starts = ends - size - 1
            data = b.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.start - starts, size + 1)]
            data[ends - 1] = 32
            data = np.concatenate([data, np.zeros(W.PADDING, np.uint8)])
            own = [np.flatnonzero(b.text_of[: len(size) - n + 1] == b.text_of[n - 1 :]) for n in range(1, max_n + 1)]
            start, end = np.concatenate([starts[i] for i in own]), np.concatenate([ends[i + n] - 1 for n, i in enumerate(own)])
            self.text_of = np.concatenate([b.text_of[i] for i in own])
        table = W.Interned(data, start, end)
        self.place = table.place
        self.used, grams = table.values()
        self.count = np.bincount(self.place, minlength=len(table.first))
        self.bucket = np.zeros(len(table.first), np.int64)
        self.bucket[self.used] = [crc32(g) % buckets for g in grams]


def _parts(column: pa.Array, max_n: int, buckets: int) -> Iterator[_Grams]:
    texts = W.as_bytes(column)
    for lo, hi in W.pieces(texts):
        yield _Grams(texts[lo:hi], max_n, buckets)


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n (long): how many n-grams of all texts fall into each bucket. A null text has none."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for g in _parts(b["text"], max_n, buckets):
                n += np.bincount(g.bucket[g.used], weights=g.count[g.used], minlength=buckets).astype(np.int64)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "n": pa.array(n[own])})

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: floor(1000 ln) of the bucket's smoothed share in the target over that in the documents. Both tables are
    counted whole; as many rows as there are buckets reach the driver."""
    both = bucket_counts(docs, max_n, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, max_n, buckets).withColumn("side", F.lit(1)))
    n = np.zeros((2, buckets), np.int64)
    for r in both.collect():
        n[r.side, r.bucket] = r.n
    s, t = n.tolist()
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """doc_id, n_words, n_features, weight (long) of each row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # a number for each bucket

    def run(batches):
        for b in batches:
            n, features, weight = [], [], []
            for g in _parts(b["text"], max_n, buckets):
                own = sent.value[g.bucket][g.place]
                sums = np.zeros(len(g.n_words), np.int64)
                np.add.at(sums, g.text_of, own)
                n.append(g.n_words)
                weight.append(sums)
                features.append(np.bincount(g.text_of, minlength=len(sums)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """A Gumbel-distributed number from the document's id, in thousandths; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawable: Column, percent: int) -> DataFrame:
    """The rows with rank (long): 1, 2, 3 ... by falling score, ties to the smaller doc_id, for the first floor(percent * N / 100) of the N rows
    that satisfy the condition; null for the rest."""
    marked = scored.withColumn("_in", F.coalesce(drawable, F.lit(False)) & F.col("score").isNotNull())
    order = [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc()]
    lying = saved(marked.repartitionByRange(*order).sortWithinPartitions(*order)).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = lying.groupBy("_part").agg(F.sum(F.col("_in").cast("long")).alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = sizes.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * percent / 100).alias("_drawn"))
    place = F.col("_before") + F.col("_row") + 1
    out = lying.join(F.broadcast(before.join(F.broadcast(total))), "_part")  # as many rows as partitions
    return out.withColumn("rank", F.when(F.col("_in") & (place <= F.col("_drawn")), place)).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (long) of every row of docs; rank is null for rows that are not drawn.

    Words have A-Z lowered. A null or empty text has no features and weighs 0; with no target texts, or none with words, the gains come from the documents alone. A null
    doc_id has no noise, so its score is null and it is never drawn. Repeated rows count each and are drawn each, side by side. A text of any
    length is taken whole. No rows give no rows; other columns are left out.
    """
    weights = written(weigh(docs, gains(docs, target, max_n, buckets), max_n))
    return ranked(weights.withColumn("score", F.col("weight") + noise(seed)), F.col("n_words") >= min_words, percent)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; rows of one id are drawn together."""
    ids = resample(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
