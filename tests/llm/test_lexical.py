import collections
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from bridgewell.llm import lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text):
    return TERM.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def plain_search(docs, items, k):
    """{(item_id, rank, doc_id, score)}; docs with distinct ids."""
    tf = {i: collections.Counter(terms(t)) for i, t in docs}
    held = {i: c for i, c in tf.items() if c}
    n, size = len(held), sum(c.total() for c in held.values())
    df = collections.Counter(w for c in held.values() for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = set()
    for item, words in asked.items():
        found = []
        for i, c in held.items():
            m = 50 + (50 * c.total() * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                found.append((-s, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]
    return [*docs, *docs[:30], "", None, "W1-w2  É", "w1 " * 20_000, "w3" * 4000]


def rows(df):
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("k", "owners", "block"), [(10, 4, 50), (3, 2, 37), (50, 1, 4096), (5, 7, 9)])
def test_search(spark, k, owners, block):
    docs = [(i * 3 - 100, t) for i, t in enumerate(corpus())]
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice([f"w{rng.randrange(80)}", f"W{rng.randrange(10)}", "none"]) for _ in range(rng.randint(0, 12)))) for i in range(23)] + [(50, "é w79"), (51, None), (52, "absent"), (3, "w77 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit("clash"), "score": F.lit(1), "item_id": F.lit(2)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(7))
    assert rows(lexical.search(df, asked, k, owners, block, 5)) == plain_search(docs, items, k)


def test_groups_of_items_and_odd_rows(spark):
    docs, items = list(enumerate(corpus(60))), [(f"q{i}", f"w{i} w{2 * i}") for i in range(11)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert rows(lexical.search(df, asked, 6, group_items=4)) == plain_search(docs, items, 6)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "w1 w2"), (1, "w1 w2"), (None, "w1 w2"), (2, "w2")], "doc_id long, text string")
    got = lexical.search(odd, spark.createDataFrame([(None, "w1"), (None, "w2")], "item_id int, text string")).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [(None, 1, None), (None, 2, 1), (None, 3, 1), (None, 4, 2)]


def test_documents_leave_accumulators_early(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(["of", "the", *rng.choices(["and", "in", "to"], k=rng.randint(5, 9)), *([f"rare{i % 7}"] if i % 10 == 0 else [])])) for i in range(3000)]
    items = [(j, f"rare{j} of the and in to") for j in range(7)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    carried, real_written = [], lexical.written

    def seen(frame):
        out = real_written(frame)
        if "cells" in out.columns:
            carried.append(out.agg(F.sum(F.length("scores"))).first()[0] // 8)
        return out

    monkeypatch.setattr(lexical, "written", seen)
    assert rows(lexical.search(df, asked, 20, block_docs=100)) == plain_search(docs, items, 20)
    assert len(carried) == lexical.OWNERS - 1 and max(carried[1:]) < 0.05 * len(docs) * len(items)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(queries.QUERIES["op13_lexical_search"](spark, SF))
    assert got == plain_search(docs, items, 50)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert set(c.execute(queries.OP13_SQL).fetchall()) == got
