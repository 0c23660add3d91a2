import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bridgewell.llm import queries, resampling
from bridgewell.llm import words as W

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def grams(text, max_n):
    w = TERM.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return w, [b" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, max_n, buckets, min_words, percent, seed):
    """{doc_id: (n_words, n_features, weight, score, rank)}; distinct ids, none null."""
    place = lambda g: zlib.crc32(g) % buckets
    have, want = (collections.Counter(place(g) for t in texts for g in grams(t, max_n)[1]) for texts in ([t for _, t in docs], target))
    s, t = have.total(), want.total()
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = {}
    for i, text in docs:
        w, g = grams(text, max_n)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(x)] for x in g)
        out[i] = [len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i in out if out[i][0] >= min_words), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(fit[: percent * len(fit) // 100]):
        out[i][4] = k + 1
    return {i: tuple(x) for i, x in out.items()}


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = [*(f"w{i}" for i in range(60)), "É", "naïve", "Ab", "x" * 40, "日本", "0"]
    made = [rng.choice([" ", "  ", "-", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return ["", None, "...", "w1 " * 30_000, "z" * 5_000, *made, *made[:9]]


def test_xxh64_equals_the_library():
    rng = random.Random(5)
    b = W.Block([bytes(rng.randrange(256) for _ in range(rng.randint(0, 90))) for _ in range(800)])
    for seed in (0, 42):
        assert W.xxh64(b.bytes, b.start, b.end, seed).tolist() == [xxhash.xxh64_intdigest(b.data[i:j], seed) for i, j in zip(b.start, b.end, strict=True)]
    assert len(W.xxh64(b.bytes, b.start[:0], b.end[:0])) == 0


def test_interned_tells_equal_hashes_apart():
    rng = random.Random(6)
    b = W.Block([bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(300)])
    for hashes in (None, np.zeros(len(b.start), np.uint64)):  # all in one run of slots
        table, slot = W.Interned(b.bytes, b.start, b.end, hashes), {}
        for i, j, p in zip(b.start, b.end, table.place.tolist(), strict=True):
            assert slot.setdefault(b.data[i:j], p) == p
        assert len(set(slot.values())) == len(slot)
        used, values = table.values()
        assert dict(zip(values, used.tolist(), strict=True)) == slot


@pytest.mark.parametrize(("max_n", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 1000, 100)])
def test_resample(spark, max_n, buckets, percent):
    docs, target = list(enumerate(texts())), [*texts(9, 4)[5:], None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("clash"), "rank": F.lit(0), "bucket": F.lit(None).cast("int")}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aim, max_n, buckets, 12, percent, 7).collect()
    want = plain_resample(docs, target, max_n, buckets, 12, percent, 7)
    assert {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got} == want and len(got) == len(want)
    if percent < 100:
        kept = resampling.drawn(df, aim, max_n=max_n, buckets=buckets, min_words=12, percent=percent, seed=7)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[4]) and kept.columns == df.columns


def test_resample_odd_rows(spark):
    long = "a b c d " * 10
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, ""), (3, None), (4, long)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none, percent=100).collect()
    assert sorted(r.rank or 0 for r in got) == [0, 0, 0, 1, 2, 3]  # rows without an id are not drawn
    one = sorted(r.rank for r in got if r.doc_id == 1)
    assert one[1] == one[0] + 1
    assert all(r.score is None for r in got if r.doc_id is None) and all(r.weight == 0 for r in got if r.doc_id in (2, 3))
    assert resampling.resample(df.limit(0), none).count() == 0
    names = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")  # ids may be strings
    assert {r.doc_id for r in resampling.resample(names, df, percent=50).collect()} == {"d1", "d2", "d3", "d4", None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_importance_resampling"](spark, SF).collect()
    want = plain_resample(docs, target, 1, 10_000, 20, 10, 2024)
    rows = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got}
    assert rows == {i: x[1:] for i, x in want.items()}
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {r[0]: r[1:] for r in c.execute(queries.OP11_SQL).fetchall()} == rows
