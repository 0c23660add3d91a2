"""Connected components of a table of links, by alternating star contraction on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import storage
from ..operators.storage import checkpoint_folder
from .memory import release

__all__ = ["checkpoint_folder", "components", "saved"]


def saved(df: DataFrame) -> DataFrame:
    """storage.saved(); what earlier steps shuffled and nothing refers to any more is given back."""
    out = storage.saved(df)
    release(df.sparkSession)
    return out


FEW = 1 << 18  # links that one task settles; more go through rounds first


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        left = low[a] != low[b]
        a, b = a[left], b[left]
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _gathered(batches):
    """The links of a task as stars: every link that it holds already joins to the smallest node it knows."""
    got = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    u, v = stars(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*got, strict=True))) if got else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})


def components(links: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, component: the smallest node reachable, for every node of the links (a, b), both long.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours
    likewise, until nothing changes. Rounds grow with the logarithm of a component's size. Links to itself and
    repeated links change nothing; null ends are left out; no links give no rows. A node of many links is never
    gathered in one place: only minima are taken by node. Links that meet in one task are contracted there before a round, and once no more than
    FEW are left one task ends the work.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark_of = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
    contracted = lambda d: d.mapInArrow(_gathered, "u long, v long")
    pairs = saved(contracted(pairs).distinct())
    mark = mark_of(pairs)
    for _ in range(most_rounds):
        if mark[0] <= few:
            pairs = saved(contracted(pairs.coalesce(1)))
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        pairs = saved(contracted(small).distinct())
        # the pairs are distinct, so equal counts and equal sums of two hashes tell that nothing has changed
        old, mark = mark, mark_of(pairs)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
