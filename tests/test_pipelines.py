import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bridgewell.operators import graph as G
from bridgewell.plans import pipelines as L


@pytest.fixture(scope="module")
def ev(spark):
    rng = np.random.default_rng(8)
    rows = []
    for q in range(6):
        for c in range(q, q + 4):
            rows.append((q, 100 + c, int(c == q), f"red shoe {q}", f"red {'shoe' if c == q else 'hat'} {c}", "a", "a" if c % 2 else "b", {"brand": "x"}, {"brand": "x" if c == q else "y"}, rng.normal(size=8).tolist(), rng.normal(size=8).tolist()))
    return spark.createDataFrame(rows, "query_id long, cand_id long, label int, query_text string, cand_text string, query_category string, cand_category string, query_specs map<string,string>, cand_specs map<string,string>, query_v array<double>, cand_v array<double>")


def test_rankers_by_name_and_number(ev):
    w = {"q": [np.eye(8)], "c": [np.eye(8)]}
    for name, more in ((1, {}), ("bm25", {}), (2, {}), (3, {"weights": w}), (4, {}), ("hybrid", {})):
        r = L.evaluate(ev, name, k=2, complete=4, **more).first()
        assert r.model == L.NUMBERS.get(name, name) and r.n_queries == 6 and 0 <= r.ndcg_at_k <= r.hr_at_k <= 1
    assert L.evaluate(ev, "bm25", complete=100).first().n_queries == 0
    with pytest.raises(ValueError, match="ranker"):
        L.evaluate(ev, "none")


def test_lists_by_brute_force(ev):
    lists = L.graph_lists(ev)
    by = {}
    for r in lists.collect():
        by.setdefault(r.query_id, {})[r.node] = np.array(r.v)
    assert all(len(m) == 5 for m in by.values())
    cos = lambda a, b: round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 9)
    graph = {(q, a, b) for q, m in by.items() for a in m for b in m if a == b or cos(m[a], m[b]) > 0.3}
    assert {tuple(r) for r in G.threshold_graph(lists).collect()} == graph
    near = {(q, a, b) for q, m in by.items() for a in m for b in sorted(m, key=lambda b: (b != a, -cos(m[a], m[b]), b))[:3]}
    assert {tuple(r) for r in G.nearest_hyperedges(lists, 3).collect()} == near
    degree = {(q, a): sum((q, a, b) in graph for b in by[q]) for q in by for a in by[q]}
    made = {(r.query_id, r.node): r.v for r in G.convolved_lists(lists).collect()}
    for (q, a), v in made.items():
        assert v == pytest.approx(sum(by[q][b] * (2 if a == b else 1) / math.sqrt((degree[q, a] + 1) * (degree[q, b] + 1)) for b in by[q] if (q, b, a) in graph))


def test_strategies(spark):
    items = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(300)], "item_id long, category string")
    pairs = spark.createDataFrame([(q, q + 10, "a") for q in range(5)], "query_id long, true_id long, category string")
    for s in L.STRATEGIES:
        rows = L.eval_dataset(pairs, items, s).collect()
        assert len(rows) == 500 and sum(r.label for r in rows) == 5 and len({(r.query_id, r.cand_id) for r in rows}) == 500
    with pytest.raises(ValueError, match="strategy"):
        L.eval_dataset(pairs, items, "other")
    with pytest.raises(ValueError, match="kind"):
        L.validate(items, "other")


def test_layered_equals_its_formula(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 1)], "src long, dst long")
    x = {n: np.random.default_rng(n).normal(size=3) for n in range(4)}
    long = spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "node long, v array<double>")
    a = np.zeros((4, 4))
    for s, t in ((0, 1), (1, 2), (3, 1)):
        a[s, t] = a[t, s] = 1
    d = np.sqrt(a.sum(0))
    step = a / np.outer(d, d)
    m = np.stack([x[n] for n in range(4)])
    want = (m + step @ m + step @ step @ m) / 3
    for r in G.layered(edges, long).collect():
        assert r.v == pytest.approx(want[r.node])


def test_validation_reads_once(spark, tmp_path):
    rows = [("u", "p", 1.0, "a"), ("u", "", 3.0, "b"), (None, "q", None, "a"), ("v", "p", 3.0, None)]
    spark.createDataFrame(rows, "user_id string, product_id string, rating double, domain string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {(r.section, r.name): r.value for r in L.validate(df, "interactions").collect()}
    assert got == {
        ("all", "n_rows"): 4, ("all", "n_users"): 2, ("all", "n_items"): 3, ("all", "blank_users"): 1, ("all", "blank_items"): 1, ("all", "min_rating"): 1, ("all", "max_rating"): 3, ("all", "avg_rating"): 2.333333,
        ("domain", "a"): 2, ("domain", "b"): 1, ("domain", None): 1, ("rating", "1.0"): 1, ("rating", "3.0"): 2, ("rating", None): 1}
    plan = L.validate(df, "interactions")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    none = {(r.section, r.name): r.value for r in L.validate(df.limit(0), "interactions").collect()}
    assert none["all", "n_rows"] == 0 and none["all", "min_rating"] is None and len(none) == 8
