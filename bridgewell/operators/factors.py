"""Matrix factorisation from pairwise rankings (BPR) by stratified gradient descent.

Users and items are dealt to blocks, and edges to the cells of the grid. A stratum takes one cell of each row and column, so that no two of its tasks touch the same factors: they
descend side by side, each in small steps over its cell's edges, with negatives from its own items. Strata are rotated until each cell has had its turn: an epoch.
Factors travel as packed blocks and are saved after each stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .products import arrays
from .storage import saved

RANK, EPOCHS, BLOCKS, RATE, SHRINK, STEP = 32, 5, 4, 0.05, 0.01, 256  # numbers of a factor; passes; blocks a side; descent; edges of a step
CELL_EDGES = 4_000_000  # edges of a cell, about: more blocks are taken beyond
STATE = "side int, block int, ids binary, x binary, loss double, n long"
NAMES = [c.split()[0] for c in STATE.split(", ")]


@dataclass
class Factors:
    """users and items: id, v. losses: of each epoch the mean of -log sigmoid(positive - negative)."""

    users: DataFrame
    items: DataFrame
    losses: list[float]


def begin(ids: np.ndarray, rank: int, side: int, block: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, side, block]).normal(scale=0.1, size=(len(ids), rank))


def descend(u: np.ndarray, v: np.ndarray, user: np.ndarray, item: np.ndarray, rate: float, shrink: float, seed: list[int]) -> float:
    """Change the factors in place, edge by edge in a seeded order, STEP edges at once; returns the sum of losses. user, item: places of the edges' ends."""
    rng = np.random.default_rng(seed)
    order, total = rng.permutation(len(user)), 0.0
    for lo in range(0, len(order), STEP):
        at = order[lo : lo + STEP]
        a, i, j = user[at], item[at], rng.integers(0, len(v), len(at))
        own, away = u[a], v[i] - v[j]
        margin = (own * away).sum(axis=1)
        total += float(np.logaddexp(0, -margin).sum())
        pull = (1 / (1 + np.exp(np.clip(margin, -500, 500))))[:, None]
        np.add.at(u, a, rate * (pull * away - shrink * own))
        np.add.at(v, i, rate * (pull * own - shrink * v[i]))
        np.add.at(v, j, rate * (-pull * own - shrink * v[j]))
    return total


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.int64())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], NAMES)


def fit(edges: DataFrame, rank: int = RANK, epochs: int = EPOCHS, blocks: int = BLOCKS, rate: float = RATE, shrink: float = SHRINK, seed: int = 7) -> Factors:
    """edges: user_idx, item_idx. Null ends take no part; repeated edges count again. No edges give no factors."""
    whole = edges.where("user_idx is not null and item_idx is not null").select(F.col("user_idx").cast("long").alias("user_idx"), F.col("item_idx").cast("long").alias("item_idx"))
    whole = saved(whole)
    blocks = max(blocks, -(-whole.count() // (blocks * CELL_EDGES)))  # one item may have a third of all edges: they lie in a cell of each user block
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = saved(whole.withColumns({"u": place("user_idx"), "i": place("item_idx")}))

    def new_block(side: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            ids = np.sort(group["id"].to_numpy())
            return _table([(side, key[0].as_py(), ids.tobytes(), begin(ids, rank, side, key[0].as_py(), seed).tobytes(), 0.0, 0)])

        return run

    def side(column: str, block: str, number: int) -> DataFrame:
        return cells.select(F.col(column).alias("id"), F.col(block).alias("block")).distinct().groupBy("block").applyInArrow(new_block(number), STATE)

    def stratum(epoch: int, shift: int):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            got = {r["side"]: r for r in right.to_pylist()}
            ids = {s: np.frombuffer(r["ids"], np.int64) for s, r in got.items()}
            x = {s: np.frombuffer(r["x"]).reshape(-1, rank).copy() for s, r in got.items()}
            loss, n = (got[0]["loss"], got[0]["n"]) if 0 in got and shift else (0.0, 0)
            if len(left):
                user, item = (left[c].to_numpy() for c in ("user_idx", "item_idx"))
                order = np.lexsort((item, user))
                loss += descend(x[0], x[1], np.searchsorted(ids[0], user[order]), np.searchsorted(ids[1], item[order]), rate, shrink, [seed, 2, epoch, shift, key[0].as_py()])
                n += len(user)
            return _table([(s, r["block"], r["ids"], x[s].tobytes(), loss if s == 0 else 0.0, n if s == 0 else 0) for s, r in got.items()])

        return run

    state, losses = saved(side("user_idx", "u", 0).unionByName(side("item_idx", "i", 1))), []
    for epoch in range(epochs):
        for shift in range(blocks):
            row = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks))).cast("int")
            own = cells.where(F.pmod(F.col("i") - F.col("u"), F.lit(blocks)) == shift).select("u", "user_idx", "item_idx")
            state = saved(own.groupBy("u").cogroup(state.withColumn("u", row).groupBy("u")).applyInArrow(stratum(epoch, shift), STATE))
        total, n = state.agg(F.sum("loss"), F.sum("n")).first()
        losses.append(total / n if n else 0.0)

    def unpacked(batches):
        for b in batches:
            for ids, x in zip(b["ids"].to_pylist(), b["x"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), arrays(np.frombuffer(x).reshape(-1, rank))], ["id", "v"])

    of = lambda s: state.where(F.col("side") == s).select("ids", "x").mapInArrow(unpacked, "id long, v array<double>")
    return Factors(of(0), of(1), losses)
