"""Vectors by id: encoding texts, exact and approximate nearest items, small networks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import grid_top, rows_of
from .forest import approximate_top, completed
from .lists import Block, Lists, scored

__all__ = ["approximate_top", "completed", "encode_with", "exact_top", "two_tower_lists", "two_towers", "without_seen"]

BLOCK = 4096  # items compared at once
MOST_QUERY_BYTES = 64 << 20  # of a query set that is sent to every task; larger ones are dealt in blocks


def encode_with(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 128, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and v of a model that `encoder` loads once for each task. Equal ids are encoded once."""

    def run(frames):
        model = encoder()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "v": list(np.asarray(model(part[text].fillna("").tolist()), np.float64))})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).dropDuplicates([key]).mapInPandas(run, f"{key} {kind}, v array<double>")


def _nearest(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
    """(query, item, score) of each query's k best of these items, higher is nearer, ties within nine digits to the smaller id."""
    out = [[], [], []]
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        s = part @ x.T
        if metric != "ip":
            s = 2 * s - (x * x).sum(axis=1) - (part * part).sum(axis=1)[:, None]
        room = 1e-8 * (1 + np.abs(s).max(initial=0.0))
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - room if s.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero(s >= least[:, None])
        exact = (x[j] * part[i]).sum(axis=1) if metric == "ip" else -((x[j] - part[i]) ** 2).sum(axis=1)
        order = np.lexsort((ids[j], -np.round(exact, 9), i))
        i, j, exact = i[order], j[order], exact[order]
        start = np.searchsorted(i, np.arange(len(part)))
        kept = np.arange(len(i)) - start[i] < k
        for o, v in zip(out, (names[lo + i[kept]], ids[j[kept]], exact[kept]), strict=True):
            o.append(v)
    return tuple(np.concatenate([np.zeros(0, kind), *o]) for o, kind in zip(out, (np.int64, np.int64, np.float64), strict=True))


def exact_top(items: DataFrame, queries: DataFrame, k: int, metric: str = "ip", key: str = "vec_id", vector: str = "embedding", most_bytes: int = MOST_QUERY_BYTES) -> DataFrame:
    """query_id, item_id, score, rank: the k best items by inner product ('ip') or squared distance ('l2'), ties to the smaller id.

    A stated query set is compared with all items in blocks. Queries of up to most_bytes go to every task, which reads its items where they lie
    and keeps the k best of each; more queries meet blocks of items over a grid, where bounds rule pairs of blocks out (blocks.grid_top). Null vectors and vectors
    of another length than the first query's take no part.
    """
    first = queries.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    schema = "query_id long, item_id long, score double"
    if first is None:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    fits = F.size(vector) == first["n"]
    q = queries.where(fits).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q"))
    x = items.where(fits).select(F.col(key).cast("long").alias("item_id"), F.col(vector).alias("x"))
    order = F.round("score", 9).desc() if metric == "ip" else F.round("score", 9).asc()
    sign = 1 if metric == "ip" else -1

    def batch(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(sign * found[2])], ["query_id", "item_id", "score"])

    if q.count() * first["n"] * 8 <= most_bytes:
        got = q.toArrow()
        sent = items.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), rows_of(got["q"])))  # most_bytes at most

        def run(batches):
            names, a = sent.value
            ids, rows, size = [], [], 0

            for b in batches:
                ids.append(b["item_id"].to_numpy())
                rows.append(rows_of(b["x"]))
                size += len(b)
                if size >= BLOCK:
                    yield batch(_nearest(names, a, np.concatenate(ids), np.concatenate(rows), k, metric))
                    ids, rows, size = [], [], 0
            if size:
                yield batch(_nearest(names, a, np.concatenate(ids), np.concatenate(rows), k, metric))

        work = x.mapInArrow(run, schema)
    else:
        id_and_x = lambda d, i, v: d.where(F.forall(v, lambda y: y.isNotNull())).select(F.col(i).alias("id"), F.col(v).alias("x"))
        work = grid_top(id_and_x(q, "query_id", "q"), id_and_x(x, "item_id", "x"), k, metric, _nearest, BLOCK // 2).withColumn("score", F.col("score") * sign)
    return work.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "item_id"))).where(F.col("rank") <= k)


def without_seen(ranked: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Drop known (user, item) pairs from over-fetched lists, rank again, cut to k."""
    left = ranked.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k)


def _tower(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    for i, w in enumerate(layers):
        x = x @ w
        if i + 1 < len(layers):
            x = np.maximum(x, 0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def two_towers(pairs: DataFrame, weights: dict[str, list[np.ndarray]]) -> DataFrame:
    """query_id, cand_id, score of given networks (one list of layer matrices a side; rectified between, unit length at the end).

    pairs: query_id, cand_id, q, c (arrays).
    """

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.slice(lo, BLOCK)
                q, c = (_tower(rows_of(part[s]), weights[s]) for s in ("q", "c"))
                yield pa.RecordBatch.from_arrays([part["query_id"], part["cand_id"], pa.array((q * c).sum(axis=1))], ["query_id", "cand_id", "score"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "cand_id")}
    return pairs.select("query_id", "cand_id", "q", "c").mapInArrow(run, f"query_id {kinds['query_id']}, cand_id {kinds['cand_id']}, score double")


def two_tower_lists(lists: Lists, weights: dict[str, list[np.ndarray]]) -> DataFrame:
    """query_id, scored (cand_id, label, score): two_towers() over lists with query_v and v; a query's vector passes its network once."""

    def measure(block: Block) -> np.ndarray:
        q, c = _tower(block.query_rows("query_v"), weights["q"]), _tower(block.rows("v"), weights["c"])
        return np.einsum("ij,ij->i", q[block.list_of], c)

    return scored(lists, {"score": measure}, ["label"])
