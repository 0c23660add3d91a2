import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgewell.functions import digests as D
from bridgewell.operators import draws as B
from bridgewell.operators import graph as G
from bridgewell.operators import keys as K
from bridgewell.operators import lists as C
from bridgewell.operators import ranking as R
from bridgewell.operators import sampling as W
from bridgewell.plans import pipelines as L


def draw(seed, below, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16) % below


@pytest.mark.parametrize("sizes", [(3, 200, 40), (150, 5, 94), (700, 400, 1)])
def test_runs_lie_in_chunks(spark, sizes):
    """Item by item as the rule says: round the end of the category, and behind the own category."""
    items = [(n * 1000 + i, f"c{n}") for n, size in enumerate(sizes) for i in range(size)]
    order = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    places = sorted(items, key=lambda r: (r[1], order(r[0]), r[0]))
    total = len(places)
    queries = [(9000 + q, c, t) for q, (t, c) in enumerate(items[:: max(1, total // 60)])]
    df = spark.createDataFrame(items, "item_id long, category string")
    asks = spark.createDataFrame(queries, "query_id long, category string, true_id long")
    got = {r.query_id: ([x.item_id for x in r.hard], [x.item_id for x in r.easy]) for r in W.quota_lists(asks, df).collect()}
    every = {r.query_id: [x.item_id for x in r["items"]] for r in W.any_lists(asks, df).collect()}
    for q, c, t in queries:
        own, start = [r[0] for r in places if r[1] == c], next(i for i, r in enumerate(places) if r[1] == c)
        rest = [r[0] for r in (places[start:] + places[:start])[len(own) :]]
        hard = min(70, len(own) - 1)
        easy = min(99 - hard, len(rest))
        hard = min(99 - easy, len(own) - 1)
        round_ = lambda pool, seed, n: [x for i in range(min(n + 1, len(pool))) if (x := pool[(draw(seed, len(pool), q) + i) % len(pool)]) != t][:n]
        if hard + easy == 99:
            assert got[q] == (round_(own, "42h", hard), round_(rest, "42e", easy))
        else:
            assert q not in got
        assert every[q] == round_([r[0] for r in places], "42a", 99)


def test_a_run_is_one_row_until_it_is_used(spark):
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"))
    asks = spark.range(50).select(F.col("id").alias("query_id"), F.lit("c1").alias("category"), (F.col("id") + 1).alias("true_id"))
    plan = W.quota_negatives(asks, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "_i#" not in plan
    plan = W.same_category_negatives(asks, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(query_id" not in plan


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6))
    x[4] = 0
    words = ["red", "blue", "shoe", "hat", "bag"]
    text = [" ".join(rng.choice(words, rng.integers(0, 5))) for _ in x]
    rows = [(q, c, int(c == q + 10), text[q], text[c] if c != 17 else None, "a", "ab"[c % 2], {"brand": "x"}, {"brand": "xy"[c % 2]}, x[q].tolist(), x[c].tolist()) for q in range(8) for c in range(q + 8, q + 20)]
    ev = spark.createDataFrame(rows, "query_id long, cand_id long, label int, query_text string, cand_text string, query_category string, cand_category string, query_specs map<string,string>, cand_specs map<string,string>, query_v array<double>, cand_v array<double>")
    sent = C.send_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, v array<double>"), "vec_id", "v")
    lists = L.as_lists(ev.withColumns({"query_v": F.col("query_id"), "cand_v": F.col("cand_id")}), "text", "category", "specs", "v")
    return ev, C.Lists(lists.rows, sent), x


@pytest.mark.parametrize("ranker", ["bm25", "embedding", "two_towers", "graph", "hybrid"])
def test_lists_of_ids_rank_as_rows_of_vectors(both, ranker):
    ev, lists, _ = both
    more = {"weights": {"q": [np.eye(6)], "c": [np.eye(6)]}} if ranker == "two_towers" else {}
    a, b = ({(r.query_id, r.cand_id): r.score for r in L.scores(e, ranker, **more).collect()} for e in (ev, lists))
    assert len(a) == 96 and a == pytest.approx(b)
    scores = L.scores(lists, ranker, **more)
    assert sorted(map(tuple, C.ranks(L.RANKERS[ranker](lists, **more)).collect())) == sorted(map(tuple, R.labelled_ranks(scores).collect()))


def test_lists_send_no_vectors(both):
    _, lists, _ = both
    assert dict(lists.rows.dtypes)["query_v"] == "bigint"
    plan = L.evaluate(lists, "graph")._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and plan.count("Join") == 0


def test_vectors_too_many_to_send_travel(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, v array<double>")
    assert C.send_vectors(v, "vec_id", "v", 8) is None and C.send_vectors(v, "vec_id", "v") is not None
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, v array<double>")
    assert C.send_vectors(ragged, "vec_id", "v") is None


def test_best_scores_are_not_derived_again_for_each_candidate(both):
    _, lists, _ = both
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (L.scores(lists, "bm25"), L.scores(lists, "hybrid"), C.ranks(L.bm25_lists(lists))):
        for best in ("array_max(", "array_min("):
            assert plan(df).count(best) == plan(df).count("array(" + best)


def test_rounded_is_what_spark_rounds_to(spark):
    x = [0.0, -0.0, 1.0000005, -1.0000005, 0.1234565, 2.5e-7, 5e-7, -5e-7, 4.9999999e-7, 1.0049995, 123456789.1234565, 1e15 + 0.3, 1e300, float("inf"), float("nan"), *np.random.default_rng(1).normal(size=2000).tolist()]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    got = C.rounded(np.array(x), 6)
    assert [repr(float(v)) for v in got] == [repr(v) for v in want]


def test_bonus_with_unknown_categories_and_scores_of_zero(spark):
    rows = [(1, [(10, 1, "red hat", "a"), (11, 0, "blue", None), (12, 0, None, "b")], "red", "a"), (2, [(10, 1, "blue", "a"), (11, 0, "hat", "b")], "red", "a"), (3, [(10, 1, "red", "a")], "red", None)]
    rows = spark.createDataFrame(rows, "query_id long, cands array<struct<cand_id: long, label: int, words: string, category: string>>, query_words string, query_category string")
    plain = {(r.query_id, r.cand_id): round(r.s, 6) for r in C.unfold(C.scored(C.Lists(rows), {"s": C.bm25_of})).collect()}
    got = {(r.query_id, r.cand_id): r.score for r in L.scores(C.Lists(rows), "bm25").collect()}
    best = max(v for (q, _), v in plain.items() if q == 1)
    bonus = {(1, 10): best if best > 0 else 1.0, (2, 10): 1.0}
    assert got == {k: pytest.approx(0.7 * v + 0.3 * bonus.get(k, 0.0)) for k, v in plain.items()}


def test_sums_of_convolved_vectors_are_made_where_lists_lie(both):
    _, lists, _ = both
    nodes = L.graph_lists(lists)
    told = G.convolved_lists(nodes, told={"total": lambda x: x.sum(axis=1), "last": lambda x: x[:, -1]})
    assert dict(told.dtypes) == {"query_id": "bigint", "node": "bigint", "total": "double", "last": "double"}
    got = {(r.query_id, r.node): (r.total, r["last"]) for r in told.collect()}
    want = {(r.query_id, r.node): (sum(r.v), r.v[-1]) for r in G.convolved_lists(nodes).collect()}
    assert len(got) == 104 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pairs_of_one_large_key_are_made_in_many_places(spark):
    a = spark.range(30_000).select(F.col("id").alias("a"), F.when(F.col("id") < 29_990, "x").when(F.col("id") < 29_995, "y").alias("k"))
    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "b long, k string")
    got = K.same_key_pairs(a, b, "k", "a")
    assert got.groupBy("b").count().collect() and {r.b: r["count"] for r in got.groupBy("b").count().collect()} == {1: 29_990, 2: 29_990, 3: 5}
    assert got.distinct().count() == 59_985
    assert got.where("k = 'x'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_pairs_of_a_large_other_side_lie_in_short_cycles(spark, tmp_path):
    a = spark.range(300).select(F.col("id").alias("a"), F.lit(7).alias("k"))
    b = spark.range(14_000).select((F.col("id") * 3).alias("b"), F.lit(7).alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are not sent to all
    try:
        K.same_key_pairs(a, b, "k", "a").select("a", "b").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4_200_000 / 2  # 1.8 bytes a pair, if the cycle is as long as the key
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.distinct().count() == got.count() == 4_200_000


def test_pairs_of_copies_and_nulls_are_those_of_the_join(spark):
    a = spark.createDataFrame([(i % 40, None if i % 7 == 0 else "n", i % 3 if i % 5 else None) for i in range(600)], "a long, more string, k int")
    b = spark.createDataFrame([(None if i % 6 == 0 else i % 30, i % 4 if i % 5 else None) for i in range(700)], "b int, k int")
    got, want = K.same_key_pairs(a, b, "k", "a"), a.join(b, "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def least(queries, items, most):
    """Item by item: the first of all items of the category in the order of the digests."""
    out = {}
    for q, t, c in queries:
        own = [i for i, k in items if k == c and c is not None and i is not None]
        if own:
            out[q] = sorted((i for i in own if t is not None and i != t), key=lambda i: md5(f"42|{q}|{i}"))[:most]
    return out


@pytest.mark.parametrize("places", ["1", "4"])
def test_same_category_draws_from_all_items(spark, places, monkeypatch):
    monkeypatch.setattr(B, "PART", 30)
    items = [(i, "big") for i in range(-3, 2600)] + [(5000 + i, "few") for i in range(40)] + [(10**18 + 7, "one"), (9001, None), (9002, "unasked")]
    queries = [(q, q if q % 9 else None, "big") for q in range(95, 160)] + [(10**15 + q, 5000 + q, "few") for q in range(70)] + [(3, 4, "one"), (4, 10**18 + 7, "one"), (5, 1, "none"), (6, 1, None)]
    df, asks = spark.createDataFrame(items, "item_id long, category string"), spark.createDataFrame(queries, "query_id long, true_id long, category string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", places)
    try:
        got = W.same_category_lists(asks, df)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.columns == ["query_id", "true_id", "category", "items"] and {(r.query_id, r.true_id, r.category) for r in rows} == {q for q in queries if q[2] not in ("none", None)}
    assert {r.query_id: [x.item_id for x in r["items"]] for r in rows} == least(queries, items, 99)
    assert len({x.item_id for r in rows if r.category == "big" for x in r["items"]}) > 500 + 99  # 500 were all that queries could draw from


@pytest.mark.parametrize("kind", ["string", "double"])
def test_same_category_of_other_ids(spark, kind):
    make = (lambda i: "é" * (i % 40) + str(i)) if kind == "string" else float
    items, queries = [(make(i), "c") for i in range(700)], [(q, make(q), "c") for q in (3, 40, 77, 10_000)]
    df, asks = spark.createDataFrame(items, f"item_id {kind}, category string"), spark.createDataFrame(queries, f"query_id long, true_id {kind}, category string")
    assert {r.query_id: [x.item_id for x in r["items"]] for r in W.same_category_lists(asks, df, most=20).collect()} == least(queries, items, 20)


def test_items_of_equal_first_words_keep_the_order_of_their_digests(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(D.FirstWords, "of", lambda self, prefixes: np.zeros((len(prefixes), self.head.shape[1]), np.uint32))
    held = B._Group(20)
    q = pa.StructArray.from_arrays([pa.array([7, 8])], ["query_id"])
    held.ask(pa.RecordBatch.from_arrays([q, pa.array(["42|7|", "42|8|"]), pa.array(["15", "600"])], ["_q", "_start", "_true"]))
    for lo in range(0, 900, 300):
        ids = pa.array(range(lo, lo + 300))
        held.add(ids, ids.cast(pa.string()))
    got = {r["query_id"]: [x["item_id"] for x in r["items"]] for r in held.done("items").to_pylist()}
    assert got == least([(7, 15, "c"), (8, 600, "c")], [(i, "c") for i in range(900)], 20)


def test_first_words_are_those_of_md5():
    rng = np.random.default_rng(5)
    for p, n in [(0, 0), (0, 5), (3, 7), (4, 4), (11, 7), (17, 19), (48, 7), (55, 0)]:
        x, starts = rng.integers(0, 256, (6, n), dtype=np.uint8), rng.integers(0, 256, (3, p), dtype=np.uint8)
        words = D.FirstWords(x, p, 4)
        for some in (starts, starts[1:]):
            want = [[int(hashlib.md5(s.tobytes() + t.tobytes()).hexdigest()[:8], 16) for t in x] for s in some]
            assert words.of(some).tolist() == want == D.first_words(some, x).tolist()


def test_negatives_of_the_same_category_leave_no_item_out(spark):
    items, queries = [(i, "c") for i in range(1200)], [(q, q, "c") for q in range(60)]
    got = W.same_category_negatives(spark.createDataFrame(queries, "query_id long, true_id long, category string"), spark.createDataFrame(items, "item_id long, category string"))
    want = least(queries, items, 99)
    assert sorted((r.query_id, r.item_id) for r in got.collect()) == sorted((q, i) for q in want for i in want[q])
    assert len({i for own in want.values() for i in own}) > 1100
