import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgewell.operators import blocks, encoder, factors, forest, products, quantiles
from bridgewell.operators import graph as G
from bridgewell.operators import keys as K
from bridgewell.operators import quality as A
from bridgewell.operators import ranking as R
from bridgewell.operators import retrieval as N
from bridgewell.operators import sampling as W
from bridgewell.operators.postings import Postings


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_empty_keys_pair_with_nothing(spark):
    a = spark.createDataFrame([("", 1), ("", 2), (None, 3), ("k", 4)], "qk string, q int")
    b = spark.createDataFrame([("", 5), ("", 6), (None, 7), ("k", 8)], "ik string, i int")
    assert rows(K.positives(a, b, "qk", "ik").select("q", "i", "label")) == [(4, 8, 1)]


def test_newest_row(spark):
    df = spark.createDataFrame([("u", "p", 1), ("u", "p", 5), ("u", "p", 3)], "user_id string, product_id string, ts int")
    assert rows(K.newest(df, ["user_id", "product_id"], "ts")) == [("u", "p", 5)]


def test_field_mapping(spark):
    df = spark.createDataFrame([("n", 1)], "product_name string, id int")
    got = K.map_fields(df, {"name": (("productName", "product_name"), "string"), "crumb": (("breadcrumb",), "string")})
    assert got.dtypes == [("name", "string"), ("crumb", "string")] and rows(got) == [("n", None)]


def test_dense_ids_are_contiguous(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") % 321).cast("string")).alias("k"))
    got = K.dense_ids(df, "k").collect()
    assert sorted(r.idx for r in got) == list(range(321)) and len({r.k for r in got}) == 321


def test_frontier_counts(spark):
    df = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "k string, source string")
    done = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert rows(K.frontier(df, done, "k", "source").select("source", "n_rows", "n_removed", "n_left")) == [("f", 2, 1, 1), ("g", 1, 1, 0)]


def catalogue(spark, own, other):
    return spark.createDataFrame([(i, "a") for i in range(own + 1)] + [(1000 + i, "b") for i in range(other)], "item_id long, category string")


@pytest.mark.parametrize(("own", "other", "hard", "easy"), [(80, 500, 70, 29), (10, 500, 10, 89), (150, 5, 94, 5), (30, 30, 0, 0)])
def test_quota(spark, own, other, hard, easy):
    q = spark.createDataFrame([(7, "a", 0), (8, "a", 1)], "query_id long, category string, true_id long")
    got = W.quota_negatives(q, catalogue(spark, own, other)).collect()
    for query, true in ((7, 0), (8, 1)):
        mine = [r for r in got if r.query_id == query]
        assert sum(r.is_hard for r in mine) == hard and sum(not r.is_hard for r in mine) == easy
        assert len({r.item_id for r in mine}) == len(mine) and true not in {r.item_id for r in mine}
        assert all((r.item_id < 1000) == r.is_hard for r in mine)


def test_benchmark_has_one_true_candidate(spark):
    q = spark.createDataFrame([(7, "a", 0)], "query_id long, category string, true_id long")
    b = W.benchmark(q, W.quota_negatives(q, catalogue(spark, 90, 90)))
    assert rows(b.groupBy().agg(F.count("*"), F.sum("label"), F.max("position"))) == [(100, 1, 100)]


def test_ranks_are_those_of_one_window(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.lit("cold")).alias("g"))
    got = W.ranked(df, "g", "k").collect()
    import hashlib

    for g in ("hot", "cold"):
        want = sorted((r.k for r in got if r.g == g), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] == want


def test_triplets(spark):
    t = W.triplets(catalogue(spark, 20, 20).union(spark.createDataFrame([(9999, "single")], "item_id long, category string"))).collect()
    assert len(t) == 41
    for r in t:
        assert r.anchor_id != r.positive_id and (r.anchor_id < 1000) == (r.positive_id < 1000) != (r.negative_id < 1000) or r.negative_id == 9999


def test_leave_one_out(spark):
    e = spark.range(3000).select((F.col("id") % 600).alias("user_idx"), F.expr("id div 600").alias("item_idx")).union(spark.createDataFrame([(9000, 1)], "user_idx long, item_idx long"))
    got = W.leave_one_out(e)
    n = {r.part: r.n for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert n == {"val": 250, "test": 250, "train": 2501}
    assert got.where("part <> 'train'").groupBy("user_idx").count().where("count > 1").count() == 0
    assert got.where("user_idx = 9000").first().part == "train"


def okapi(docs, query):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocab = {w for d in docs for w in d}
    idf = {w: math.log(n - (f := sum(w in d for d in docs)) + 0.5) - math.log(f + 0.5) for w in vocab}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query) for d in docs]


def test_bm25(spark):
    texts = ["red small ring", "blue ring ring", "green bolt", "red red anvil tall"]
    pairs = spark.createDataFrame([("q", "red ring red", i, t) for i, t in enumerate(texts)], "query_id string, query_text string, cand_id int, cand_text string")
    got = [r.score for r in R.bm25(pairs).orderBy("cand_id").collect()]
    assert got == pytest.approx(okapi([t.split() for t in texts], ["red", "ring", "red"]))
    top = R.bm25_corpus(spark.createDataFrame([("q", "red ring red")], "query_id string, query_text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 2).collect()
    assert {r.doc_id for r in top} <= {0, 1, 3} and len(top) == 2


@pytest.mark.parametrize("block", [7, 4096])
def test_bm25_corpus_against_all(spark, block):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(40)]
    chance = 1 / np.arange(1, 41)
    draw = lambda n: rng.choice(vocabulary, n, p=chance / chance.sum()).tolist()
    texts = [draw(rng.integers(0, 30)) for _ in range(300)]
    texts += [texts[5]] * 60  # a third are copies
    asks = {f"q{i}": draw(rng.integers(1, 6)) for i in range(25)} | {"none": ["absent"]}
    docs = spark.createDataFrame([(i * 2, " ".join(t)) for i, t in enumerate(texts)] + [(10**6, None)], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asks.items()], "query_id string, query_text string")
    for most in (4096, 9):
        got = R.bm25_corpus(q, docs, 8, most, block).collect()
        for i, w in asks.items():
            s = np.round(okapi([*texts, []], w), 6)
            has = [k for k in range(len(texts)) if set(w) & set(texts[k])]
            want = sorted(has, key=lambda k: (-s[k], k))[:8]
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
            assert [r.doc_id for r in mine] == [2 * k for k in want] and [r.score for r in mine] == pytest.approx([s[k] for k in want], abs=2e-6)
    assert R.bm25_corpus(q, docs.limit(0), 3).count() == 0 and R.bm25_corpus(q.limit(0), docs, 3).count() == 0


def test_postings_that_cannot_count_are_not_read():
    rng = np.random.default_rng(7)
    n = 4000
    rare = rng.choice(n, 40, replace=False)
    doc, code = np.concatenate([np.arange(n), rng.integers(0, n, 3000), rare]), np.concatenate([np.zeros(n), np.ones(3000), np.full(40, 2)]).astype(int)
    sizes = rng.integers(5, 40, n)
    whole, some = Postings(sizes, doc, code, 20.0), Postings(sizes, doc, code, 20.0)
    at, score = whole.search([0, 1, 2], [0.1, 0.5, 6.0], 0.0)
    best = np.sort(score)[-10]
    at_2, score_2 = some.search([0, 1, 2], [0.1, 0.5, 6.0], best)
    assert set(at_2) == set(at[score >= best]) and np.allclose(np.sort(score_2), np.sort(score[score >= best]))
    assert some.read < 0.05 * whole.read
    none = Postings(sizes, doc, code, 20.0)
    assert len(none.search([0, 1], [0.1, 0.5], best)[0]) == 0 and none.read == 0  # the block is passed over


def test_category_bonus(spark):
    s = spark.createDataFrame([("q", 1, 2.0, False), ("q", 2, 1.0, True)], "query_id string, cand_id int, score double, same boolean")
    assert [round(r.score, 6) for r in R.with_category_bonus(s, F.col("same")).orderBy("cand_id").collect()] == [1.4, 1.3]
    z = s.withColumn("score", F.lit(0.0))
    assert [r.score for r in R.with_category_bonus(z, F.col("same")).orderBy("cand_id").collect()] == [0.0, 0.3]


def test_metrics(spark):
    r = spark.createDataFrame([("a", 1), ("b", 3), ("c", 11), ("d", None)], "query_id string, rank int")
    m = R.metrics(r).first()
    assert (m.hr_at_k, m.ndcg_at_k, m.n_queries) == (0.5, 0.375, 4)
    hr = [R.metrics(r, k).first().hr_at_k for k in (1, 3, 10, 20)]
    assert hr == sorted(hr)


def test_losses(spark):
    p = spark.createDataFrame([(1.0, 1.0)], "pos double, neg double")
    assert R.pair_loss(p).first()[0] == pytest.approx(math.log(2), abs=1e-6)
    assert R.margin_loss(p, 0.2).first()[0] == pytest.approx(0.2)


def vectors(spark, n=60, dims=6):
    x = np.random.default_rng(3).normal(size=(n, dims)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("most_bytes", [N.MOST_QUERY_BYTES, 1])  # queries sent to every task, and dealt in blocks
def test_exact_top(spark, metric, most_bytes, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    x, df = vectors(spark)
    df = df.union(spark.createDataFrame([(90, None), (91, [1.0])], df.schema))
    got = N.exact_top(df, df.where("vec_id < 5"), 4, metric, most_bytes=most_bytes).collect()
    assert N.exact_top(df, df.where("vec_id < 0"), 4, metric).count() == 0
    for q in range(5):
        s = x.astype(float) @ x[q].astype(float) if metric == "ip" else -((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(60), -np.round(s, 9)))[:4].tolist()


def nearest_pairs(df, asks, k):
    return {(r.query_id, r.item_id) for r in N.exact_top(df, asks, k, "l2").collect() if r.query_id != r.item_id}


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "small", "large"])
def test_approximate_top(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clustered":
        x = rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] * 5 + x * 0.3
    if kind == "equal":
        x[:1200] = x[0]
    x = (x * {"small": 1e-3, "large": 1e3}.get(kind, 1.0)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df = df.union(spark.createDataFrame([(9000, None), (9001, [1.0]), (9002, [float("nan")] * 24), (9003, [float("inf")] * 24)], df.schema)).repartition(5).cache()
    asks = df.where("vec_id % 30 = 0")
    got = N.approximate_top(df, asks, 10, leaf=64, sample=600, chunk=100).collect()
    assert len(got) == 1000 and all(r.query_id != r.item_id and r.item_id < 3000 for r in got)
    y = x.astype(float)
    hit = 0
    for q in range(0, 3000, 30):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and len({r.item_id for r in mine}) == 10
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert [r.dist for r in mine] == pytest.approx([d[r.item_id] for r in mine])
        d[q] = np.inf
        hit += len({r.item_id for r in mine} & set(np.lexsort((np.arange(3000), np.round(d, 9)))[:10].tolist()))
    assert hit >= 900
    df.unpersist()


@pytest.mark.parametrize("most_bytes", [1, 1 << 26])
@pytest.mark.parametrize("kind", ["plain", "small", "large", "equal"])
def test_completed_is_exact(spark, kind, most_bytes):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 24))
    if kind == "equal":
        x[:900] = x[0]
    x = (x * {"small": 1e-3, "large": 1e3}.get(kind, 1.0)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df = df.union(spark.createDataFrame([(9000, None), (9001, [1.0]), (9002, [float("nan")] * 24), (9003, [float("inf")] * 24)], df.schema)).repartition(3).cache()
    asks = df.where("vec_id % 40 = 0")
    first = N.approximate_top(df, asks, 10, leaf=32, sample=300, wanted=0.3)
    got = N.completed(first, df, asks, 10, most_bytes=most_bytes).collect()
    y, want = x.astype(float), set()
    for q in range(0, 2000, 40):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        near = [i for i in np.lexsort((np.arange(2000), np.round(d, 9))) if i != q][:10]
        want |= {(q, int(i), n) for n, i in enumerate(near, 1)}
        assert [r.dist for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == pytest.approx(d[near])
    assert {(r.query_id, r.item_id, r.rank) for r in got} == want and len(got) == 500
    assert {(r.query_id, r.item_id, r.rank) for r in first.collect()} != want
    assert N.completed(first.limit(0), df, asks, 10).count() == 0
    few = df.where("vec_id < 5")
    assert N.completed(N.approximate_top(few, few, 10), few, few, 10, most_bytes=most_bytes).count() == 20
    df.unpersist()


def test_approximate_top_visits_few_leaves_of_clustered_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(64, 16))[rng.integers(0, 64, 4096)] * 8 + rng.normal(size=(4096, 16)) * 0.2
    found = forest.Forest.fit(np.arange(4096), x, 4096 * 16, 10, 4, 512, 0.95, 7)
    assert found.leaves == 128 and found.probes < 0.1 * 4 * found.leaves
    cells = found.place(x)
    assert all(np.bincount(cells[:, t] - t * found.leaves, minlength=found.leaves).max() < 8 * 4096 / found.leaves for t in range(4))
    best = found.order(x[:50])
    assert all(set(cells[i]) <= set(best[i, :4].tolist()) for i in range(50))  # a query's own leaves come first


def test_approximate_top_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = N.approximate_top(df, df.where("vec_id = 1"), 10).orderBy("rank").collect()
    assert [(r.item_id, round(r.dist, 6)) for r in got] == [(2, 0.0), (3, 1.414214)]
    assert N.approximate_top(df.limit(0), df, 3).count() == 0 and N.approximate_top(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_grid_passes_over_blocks(spark, metric):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, 2000)] * 6 + rng.normal(size=(2000, 8)) * 0.2).astype(np.float32)
    x[:500] = x[0]  # a full cell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<float>").repartition(4)
    asked = df.where("id % 3 = 0")
    _, pivots = blocks.some(df, 64)
    _, known = blocks.some(df, 300)
    q, b = blocks.packed(asked, pivots, 50, known, 5, metric), blocks.packed(df, pivots, 50)
    assert b.agg(F.sum("n"), F.max("n")).first() == (2000, 50) and q.agg(F.sum("n")).first()[0] == 667
    left = blocks.block_pairs(q, b, metric)
    assert left.count() < 0.6 * q.count() * b.count() and left.distinct().count() == left.count()
    named = df.withColumnsRenamed({"id": "vec_id", "x": "embedding"})
    got = N.exact_top(named, named.where("vec_id % 3 = 0"), 5, metric, most_bytes=1)
    plan = got._jdf.queryExecution().toString()
    assert "Join" in plan and "block#" in plan
    y, by = x.astype(float), {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.item_id))
    for i in range(0, 2000, 3):
        s = y @ y[i] if metric == "ip" else -((y - y[i]) ** 2).sum(1)
        assert [j for _, j in sorted(by[i])] == np.lexsort((np.arange(2000), -np.round(s, 9)))[:5].tolist()


def test_encoders(spark):
    t = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "item_id long, text string")
    got = N.encode_with(t, lambda: lambda texts: np.array([[len(x), 1.0] for x in texts])).collect()
    assert sorted((r.item_id, r.v) for r in got) == [(1, [3.0, 1.0]), (2, [0.0, 1.0])]


def test_learned_encoder(spark, monkeypatch):
    monkeypatch.setattr(encoder, "ENTRIES", 64)
    rng = np.random.default_rng(11)
    topics = [[f"{c}{i}" for i in range(25)] for c in "abcde"]
    texts = [" ".join(rng.choice(topics[i % 5], 12)) for i in range(100)]
    near = texts[3].split()
    near[0] = "Zz"
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(near), texts[3], None, "unknown words"])), "item_id long, text string").repartition(3)
    m = encoder.fit(df, 8, rounds=6)
    words = [t.lower().split() for t in [*texts, " ".join(near), texts[3]]]
    a = np.zeros((len(words) + 2, len(m.terms)))
    for i, w in enumerate(words):
        for k, t in enumerate(m.terms):
            if t in w:
                a[i, k] = (1 + math.log(w.count(t))) * (math.log(105 / (1 + sum(t in x for x in words))) + 1)
        a[i] /= np.linalg.norm(a[i])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert m.singular[:5] == pytest.approx(s[:5], rel=1e-6) and np.abs(m.singular - s[:8]).max() < 0.05
    assert np.allclose(np.abs((m.basis[:, :5] * vt[:5].T).sum(0)), 1, atol=1e-4) and np.allclose(m.basis.T @ m.basis, np.eye(8), atol=1e-9)
    for encode in (encoder.encode, encoder.encode_once):
        got = {r.item_id: np.array(r.v) for r in encode(df, m).collect()}
        assert len(got) == 104 and np.allclose(got[3], got[101]) and not got[102].any() and not got[103].any()
        x = a[0] @ m.basis
        assert np.allclose(got[0], x / np.linalg.norm(x))
        assert got[3] @ got[100] > max(got[3] @ got[i] for i in range(100) if i % 5 != 3)
    none = encoder.fit(df.limit(0), 4)
    assert encoder.encode(df, none).first().v == [0.0] * 4


def test_encoder_splits_texts_twice_whatever_its_rounds(spark):
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} b{i % 5} c{i}") for i in range(200)] + [(200, None), (201, "")], "item_id long, text string")
    few = encoder.fit(df.mapInArrow(told, df.schema), 4, rounds=5)
    assert seen.value <= 3 * 202  # counted, split for frequencies, coded
    plain = encoder.fit(df.withColumn("text", F.coalesce("text", F.lit(""))), 4, rounds=5)
    assert np.allclose(few.basis, plain.basis) and np.allclose(few.singular, plain.singular) and len(few.terms) == 12


def test_reports(spark):
    i = spark.createDataFrame([("u", "", 1.0), ("u", "p", None), (None, "p", 3.0)], "user_id string, product_id string, rating double")
    r = A.interaction_report(i).first()
    assert (r.n_rows, r.n_users, r.blank_users, r.blank_items, r.avg_rating) == (3, 1, 1, 1, 2.0)
    assert A.estimated_bytes(i) > 0


def test_exact_quantiles_by_selection(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=3000), "b": np.repeat(5.0, 700), "c": np.concatenate([np.repeat(1.5, 900), rng.exponential(size=500) * 1e6]), "d": np.array([2.0, 1.0]), None: rng.integers(0, 7, 400).astype(float), "e": np.array([-3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("none", None)], "g string, v double").repartition(4)
    got = {r.g: r.q for r in quantiles.exact_quantiles(df, "g", "v", (0.0, 0.25, 0.5, 0.9, 1.0), cells=8, most=20).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, (0.0, 0.25, 0.5, 0.9, 1.0)))
    few, many = ({r.g: tuple(r) for r in A.distribution_by(df, "g", "v", most).collect()} for most in (1 << 20, 100))
    assert few.keys() == many.keys() and all(few[g][1:] == pytest.approx(many[g][1:]) for g in groups) and many["none"][1:] == (None,) * 5 + (0,)
    assert quantiles.exact_quantiles(df.limit(0), "g", "v", (0.5,)).count() == 0


def dense(long):
    return {r.node: dict(enumerate(r.v)) for r in long.collect()}


def test_propagation_matches_matrices(spark):
    e = spark.createDataFrame([(0, 10), (0, 11), (1, 11), (2, 12)], "src long, dst long")
    x = {n: np.array([n, 1.0]) for n in (0, 1, 2, 10, 11, 12)}
    long = spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "node long, v array<double>")
    ids = sorted(x)
    a = np.zeros((6, 6))
    for s, d in [(0, 10), (0, 11), (1, 11), (2, 12)]:
        a[ids.index(s), ids.index(d)] = a[ids.index(d), ids.index(s)] = 1
    inv = 1 / np.sqrt(a.sum(1))
    norm = a * inv[:, None] * inv[None, :]
    x0 = np.array([x[n] for n in ids])
    want = (x0 + norm @ x0 + norm @ norm @ x0) / 3
    got = dense(G.layered(e, long))
    for k, n in enumerate(ids):
        assert [got[n][0], got[n][1]] == pytest.approx(want[k])
    mean = dense(G.mean_of_neighbours(e, long))
    assert mean[11][0] == pytest.approx(0.5)
    assert rows(G.validity(e, spark.createDataFrame([(0,), (1,)], "node long"))) == [(4, 1, 4)]


def test_hypergraph_steps_match_matrices(spark):
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1)]
    h = np.zeros((3, 2))
    for n, e in pairs:
        h[n, e] = 1
    x = np.array([[1.0], [2.0], [4.0]])
    inc = spark.createDataFrame(pairs, "node long, hyperedge long")
    long = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    dv, de = h.sum(1), h.sum(0)
    for normal, want in ((False, h @ h.T @ x), (True, np.diag(dv**-0.5) @ h @ np.diag(1 / de) @ h.T @ np.diag(dv**-0.5) @ x)):
        got = dense(G.hypergraph_step(inc, long, normal))
        assert [got[i][0] for i in range(3)] == pytest.approx(want[:, 0])
    assert G.unpack(long).count() == 3


def test_product_equals_matrices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(products, "CELL_EDGES", 300)  # a node with a third of all edges lies in many parts
    src, dst, w = rng.integers(0, 60, 3000), rng.integers(0, 50, 3000), rng.normal(size=3000)
    src[:1000], dst[1000:1500] = 7, 3
    x = rng.normal(size=(55, 5))  # nodes from 55 on have no vector
    e = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(src, dst, w, strict=True)] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None)], "src int, dst long, weight double")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(None, [1.0] * 5), (99, None)], "node long, v array<double>")
    want = np.zeros((50, 5))
    np.add.at(want, dst[src < 55], x[src[src < 55]] * w[src < 55][:, None])
    got = dense(products.product(e, v))
    assert set(got) == set(dst[src < 55].tolist())
    for n, r in got.items():
        assert list(r.values()) == pytest.approx(want[n])
    assert products.product(e.limit(0), v).count() == 0 and products.product(e, v.limit(0)).count() == 0
    plan = products.product(e, v)._jdf.queryExecution().toString()
    assert "Generate posexplode" not in plan and plan.count("FlatMapCoGroupsInArrow") >= 1


def test_convolution_step_equals_matrices(spark):
    rng = np.random.default_rng(4)
    lists = {q: rng.normal(size=(rng.integers(1, 9), 4)) for q in ["a", "b", "c", None]}
    lists["b"][0] = 0  # a zero vector has its own loop once
    df = spark.createDataFrame([(q, i, r.tolist()) for q, x in lists.items() for i, r in enumerate(x)], "query_id string, node int, v array<double>").repartition(3)
    got = {(r.query_id, r.node): r.v for r in G.convolved_lists(df).collect()}
    assert len(got) == sum(map(len, lists.values()))
    for q, x in lists.items():
        n = np.linalg.norm(x, axis=1)
        a = ((x @ x.T) / np.maximum(np.outer(n, n), 1e-300) > 0.3) + np.eye(len(x))
        d = a.sum(1) ** -0.5
        for i, r in enumerate((d[:, None] * a * d) @ x):
            assert got[q, i] == pytest.approx(r)


def test_similarity_lists(spark):
    li = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("q", 2, [1.0, 0.1]), ("q", 3, [0.0, 1.0])], "query_id string, node int, v array<double>")
    assert rows(G.threshold_graph(li).select("src", "dst")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert rows(G.nearest_hyperedges(li, 2).where("hyperedge = 1").select("node")) == [(1,), (2,)]


def test_attribute_vocabulary(spark):
    i = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "x", "b": "y"})], "item_id long, specs map<string,string>")
    assert sorted(r.attribute for r in G.attribute_vocabulary(i).collect()) == ["a:x", "b:y"]
    assert G.attribute_incidence(i).count() == 3


def plain_factors(spark, pairs, rank, epochs, blocks, rate, shrink, seed):
    """The same schedule without Spark."""
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    place = {r.x: r.b for r in spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in {*users, *items}])).alias("x")).withColumn("b", F.pmod(F.xxhash64("x"), F.lit(blocks))).collect()}
    block = lambda ids: [np.array([i for i in ids if place[i] == b]) for b in range(blocks)]
    own = [block(users), block(items)]
    x = [[factors.begin(ids, rank, s, b, seed) for b, ids in enumerate(own[s])] for s in (0, 1)]
    losses = []
    for epoch in range(epochs):
        total = 0.0
        for shift in range(blocks):
            for b in range(blocks):
                c = (b + shift) % blocks
                cell = sorted((u, i) for u, i in pairs if place[u] == b and place[i] == c)
                if cell:
                    u, i = (np.array(y) for y in zip(*cell, strict=True))
                    total += factors.descend(x[0][b], x[1][c], np.searchsorted(own[0][b], u), np.searchsorted(own[1][c], i), rate, shrink, [seed, 2, epoch, shift, b])
        losses.append(total / len(pairs))
    return [{int(i): x[s][b][k] for b in range(blocks) for k, i in enumerate(own[s][b])} for s in (0, 1)], losses


def test_factors_equal_a_plain_run_and_rank_planted_items(spark):
    rng = np.random.default_rng(3)
    pairs, held = [], []
    for u in range(80):  # users like the items of their group
        liked = rng.choice([i for i in range(60) if i % 4 == u % 4], 9, replace=False)
        pairs += [(u, int(i) + 1000) for i in liked[:8]]
        held.append((u, int(liked[8]) + 1000))
    df = spark.createDataFrame([*pairs, (None, 1000), (1, None)], "user_idx int, item_idx int").repartition(3)
    m = factors.fit(df, 8, 12, 3, 0.1, 0.01)
    (u, v), losses = plain_factors(spark, pairs, 8, 12, 3, 0.1, 0.01, 7)
    assert m.losses == pytest.approx(losses) and m.losses[-1] < 0.7 * m.losses[0]
    got = [{r.id: np.array(r.v) for r in d.collect()} for d in (m.users, m.items)]
    for mine, plain in zip(got, (u, v), strict=True):
        assert set(mine) == set(plain) and all(np.allclose(mine[k], plain[k]) for k in mine)
    seen = {(a, b) for a, b in pairs}
    hits = 0
    for a, b in held:
        others = rng.choice([i + 1000 for i in range(60) if (a, i + 1000) not in seen and i + 1000 != b], 30, replace=False)
        hits += sum(u[a] @ v[int(o)] > u[a] @ v[b] for o in others) < 10 * 31 / 100
    assert hits > 0.3 * len(held)  # chance: 0.1
    none = factors.fit(df.limit(0), 4, 1, 2)
    assert none.users.count() == 0 and none.losses == [0.0]


def test_two_towers_and_seen(spark):
    p = spark.createDataFrame([(1, 2, [1.0, 0.0], [1.0, 0.0])], "query_id long, cand_id long, q array<double>, c array<double>")
    assert N.two_towers(p, {"q": [np.eye(2)], "c": [np.eye(2)]}).first().score == pytest.approx(1.0)
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(40, 2, 6)), {s: [rng.normal(size=(6, 16)), rng.normal(size=(16, 3))] for s in "qc"}
    many = spark.createDataFrame([(i, -i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(x)], "query_id long, cand_id long, q array<double>, c array<double>")
    got = {r.query_id: r.score for r in N.two_towers(many, w).collect()}
    for i, (a, b) in enumerate(x):
        left, right = np.maximum(a @ w["q"][0], 0) @ w["q"][1], np.maximum(b @ w["c"][0], 0) @ w["c"][1]
        assert got[i] == pytest.approx(left @ right / np.linalg.norm(left) / np.linalg.norm(right))
    ranked = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8), (1, 7, 0.7)], "user_id long, item_id long, score double")
    assert rows(N.without_seen(ranked, spark.createDataFrame([(1, 5)], "user_id long, item_id long"), 1).select("item_id", "rank")) == [(6, 1)]
