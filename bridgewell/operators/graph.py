"""Graph operators over edge tables: degrees, mean aggregation, propagation, similarity graphs and hypergraphs.

Vectors are arrays (node, v); sums over edges are products of packed edges and blocks of vectors (products.py).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import dense_ids
from .lists import Block, Lists
from .products import add_up, grid, over_lists, product
from .storage import saved


def bipartite(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """user_idx, item_idx: distinct interactions with known items, both sides numbered."""
    use = interactions.select("user_id", "product_id").join(items.select("product_id").distinct(), "product_id", "left_semi").distinct()
    return use.join(dense_ids(use, "user_id", "user_idx"), "user_id").join(dense_ids(use, "product_id", "item_idx"), "product_id").select("user_idx", "item_idx")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def validity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, and those whose src or dst is no node."""
    ids = nodes.select("node").distinct()
    marked = edges.join(ids.select(F.col("node").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ids.select(F.col("node").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return marked.agg(F.count("*").alias("n_edges"), F.sum(F.when(F.col("_s").isNull(), 1).otherwise(0)).alias("dangling_src"), F.sum(F.when(F.col("_d").isNull(), 1).otherwise(0)).alias("dangling_dst"))


def degrees(edges: DataFrame, side: str = "src") -> DataFrame:
    return edges.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("degree"))


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, weight: 1 over the root of the product of the degrees of both ends."""
    a, b = degrees(edges, "src"), degrees(edges, "dst")
    return edges.join(a.select(F.col("node").alias("src"), F.col("degree").alias("_a")), "src").join(b.select(F.col("node").alias("dst"), F.col("degree").alias("_b")), "dst").select(
        "src", "dst", (1 / F.sqrt(F.col("_a") * F.col("_b"))).alias("weight"))


def unpack(vectors: DataFrame, node: str = "node", vector: str = "v") -> DataFrame:
    return vectors.select(F.col(node).alias("node"), F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def mean_of_neighbours(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, v of dst nodes: the mean over their src nodes that have a vector, counted along in a last place of the vectors."""
    counted = product(edges.withColumn("weight", F.lit(1.0)), vectors.withColumn("v", F.concat(F.col("v").cast("array<double>"), F.array(F.lit(1.0)))))
    return counted.select("node", F.transform(F.slice("v", F.lit(1), F.size("v") - 1), lambda x: x / F.element_at("v", -1)).alias("v"))


def layered(edges: DataFrame, vectors: DataFrame, layers: int = 2) -> DataFrame:
    """node, v: the mean of the vectors and their propagations over an undirected graph (edges in both directions). The weighted edges and each layer are
    saved, so that no layer derives the ones before it again."""
    weighted = saved(normalised(edges.unionByName(reverse(edges)).distinct()))
    steps = [saved(vectors.select("node", "v"))]
    shape = grid(weighted, steps[0])
    for _ in range(layers):
        steps.append(saved(product(weighted, steps[-1], shape)))
    total = steps[0]
    for step in steps[1:]:
        total = total.unionByName(step)
    return add_up(total, shape[0]).select("node", F.transform("v", lambda x: x / (layers + 1)).alias("v"))


def within_lists(lists: DataFrame | Lists, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], names: tuple[str, str]) -> DataFrame:
    """query_id and the two nodes of each chosen pair of a list. lists: query_id, node (long), v, or Lists with nodes in cands; a list holds a query and its candidates, each once.
    choose(nodes, similarities rounded to nine digits): pairs of places."""

    def each(nodes: np.ndarray, x: np.ndarray) -> tuple:
        pairs = choose(nodes, _similar(x))
        return nodes[pairs[:, 0]], nodes[pairs[:, 1]]

    return over_lists(lists, each, list(names), [pa.int64(), pa.int64()])


def _similar(x: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of rows, rounded to nine digits."""
    length = np.sqrt((x * x).sum(axis=1))
    return np.round((x @ x.T) / np.maximum(np.outer(length, length), 1e-300), 9)


def threshold_graph(lists: DataFrame | Lists, above: float = 0.3) -> DataFrame:
    """query_id, src, dst: nodes of a list more similar than the bound, and each node with itself."""
    return within_lists(lists, lambda nodes, sim: np.argwhere((sim > above) | np.eye(len(nodes), dtype=bool)), ("src", "dst"))


def nearest_hyperedges(lists: DataFrame | Lists, k: int = 5) -> DataFrame:
    """query_id, hyperedge, node: each node names a hyperedge of its k most similar nodes, itself first, ties to the smaller node."""

    def choose(nodes: np.ndarray, sim: np.ndarray) -> np.ndarray:
        np.fill_diagonal(sim, np.inf)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # nodes stand in order, so ties go to the smaller one
        return np.stack([np.repeat(np.arange(len(nodes)), best.shape[1]), best.ravel()], axis=1)

    return within_lists(lists, choose, ("hyperedge", "node"))


def convolved_lists(lists: DataFrame | Lists, above: float = 0.3, told: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """query_id, node, v (or the numbers that `told` makes of the matrix of a list's vectors, so that these stay in their task) after one graph-convolution step over the nodes of each list that are more similar than the bound: weights of 1 over the root of both degrees. Each node's
    own loop is added to the similarities, where it stands already (but for a zero vector), so it weighs 2."""

    def each(nodes: np.ndarray, x: np.ndarray) -> tuple:
        made = _convolved(x, above)
        return nodes, *([f(made) for f in told.values()] if told else [made])

    if told:
        return over_lists(lists, each, ["node", *told], [pa.int64(), *[pa.float64()] * len(told)])
    return over_lists(lists, each, ["node", "v"], [pa.int64(), pa.list_(pa.float64())])


def _convolved(x: np.ndarray, above: float) -> np.ndarray:
    linked = (_similar(x) > above) + np.eye(len(x))
    root = np.sqrt(linked.sum(axis=0))
    return (linked / np.outer(root, root)) @ x


def convolved_products(block: Block, above: float = 0.3) -> np.ndarray:
    """As propagated_scores(convolved_lists()), for the candidates of a block of lists, whose convolved vectors never leave their task; not a number for candidates without a vector, and where
    the query has none."""
    q, x, out, lo = block.query_rows("query_v"), block.rows("v"), [], 0
    for own, n in zip(q, block.size, strict=True):
        part = np.concatenate([own[None], x[lo : lo + n]])
        known, score = ~np.isnan(part).any(axis=1), np.full(n, np.nan)
        if known[0]:
            made = _convolved(part[known], above)
            score[known[1:]] = made[1:] @ made[0]
        out.append(score)
        lo += n
    return np.concatenate(out) if out else np.zeros(0)


def propagated_scores(convolved: DataFrame, asks: DataFrame) -> DataFrame:
    """query_id, cand_id, score: inner products of each query's vector with its candidates' after the step. asks: query_id, node (the query's own)."""
    q = convolved.join(asks, ["query_id", "node"]).select("query_id", F.col("node").alias("_own"), F.col("v").alias("_q"))
    met = convolved.join(q, "query_id").where(F.col("node") != F.col("_own"))
    return met.select("query_id", F.col("node").alias("cand_id"), F.aggregate(F.zip_with("v", "_q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))


def attribute_vocabulary(items: DataFrame, specs: str = "specs") -> DataFrame:
    """attribute (key:value), idx."""
    pairs = items.select(F.explode(F.map_entries(specs)).alias("e")).select(F.concat(F.col("e.key"), F.lit(":"), F.col("e.value")).alias("attribute"))
    return dense_ids(pairs, "attribute")


def attribute_incidence(items: DataFrame, key: str = "item_id", specs: str = "specs") -> DataFrame:
    """node, hyperedge (the attribute's idx), sparse."""
    pairs = items.select(F.col(key).alias("node"), F.explode(F.map_entries(specs)).alias("e")).select("node", F.concat(F.col("e.key"), F.lit(":"), F.col("e.value")).alias("attribute"))
    return pairs.join(attribute_vocabulary(items, specs), "attribute").select("node", F.col("idx").alias("hyperedge")).distinct()


def hypergraph_step(incidence: DataFrame, vectors: DataFrame, normal: bool = False, least: float = 1e-6) -> DataFrame:
    """node, v: node vectors summed to hyperedges and back; with degree weights if `normal` (node side by roots, edge side by inverse). incidence: node, hyperedge."""
    h = incidence.select("node", "hyperedge")
    up = down = F.lit(1.0)
    if normal:
        dv = h.groupBy("node").agg(F.greatest(F.count("*").cast("double"), F.lit(least)).alias("dv"))
        de = h.groupBy("hyperedge").agg(F.greatest(F.count("*").cast("double"), F.lit(least)).alias("de"))
        h = h.join(dv, "node").join(de, "hyperedge")
        up, down = 1 / F.sqrt("dv") / F.col("de"), 1 / F.sqrt("dv")
    h = saved(h.select("node", "hyperedge", up.alias("up"), down.alias("down")))
    edge = product(h.select(F.col("node").alias("src"), F.col("hyperedge").alias("dst"), F.col("up").alias("weight")), vectors)
    return product(h.select(F.col("hyperedge").alias("src"), F.col("node").alias("dst"), F.col("down").alias("weight")), saved(edge))
