"""Sparse matrices of edges times dense matrices of node vectors.

Nodes are dealt to blocks by hash, and edges to cells of a grid: the block of their source, and a part of their target. A cell multiplies its packed edges with
its block's vectors and sends one sum for each target, as an array; the sums of a target are added up in the target's block. So neither a vector nor a sum is ever
split into rows of one number, and what is shuffled grows with nodes times blocks, not with edges times dimensions. A node with very many edges has them in many parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rows_of
from .lists import Block, Lists, over_blocks

CELL_EDGES, BLOCK_BYTES, CHUNK = 1 << 17, 16 << 20, 1 << 14  # edges of a cell, about; vectors of a block; edges multiplied at once
OUT = "node long, v array<double>"


def arrays(x: np.ndarray) -> pa.Array:
    """Rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def _table(nodes: np.ndarray, x: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(nodes, pa.int64()), arrays(x)], ["node", "v"])


def _block(column, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def add_up(sums: DataFrame, blocks: int | None = None) -> DataFrame:
    """node, v: the sum of the vectors of each node. Equally long vectors; null nodes and vectors take no part."""
    n = blocks or _blocks(sums)

    def add(group: pa.Table) -> pa.Table:
        nodes, x = group["node"].to_numpy(), rows_of(group["v"])
        order = np.argsort(nodes, kind="stable")
        nodes, x = nodes[order], x[order]
        start = np.flatnonzero(np.diff(nodes, prepend=nodes[0] - 1))
        return _table(nodes[start], np.add.reduceat(x, start))

    whole = sums.where("node is not null and v is not null").select(F.col("node").cast("long").alias("node"), "v")
    return whole.groupBy(_block("node", n)).applyInArrow(add, OUT)


def _blocks(vectors: DataFrame) -> int:
    """Blocks for so many vectors: as many as partitions, or more where that would exceed BLOCK_BYTES."""
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    return max(least, -(-rows * 8 * (size or 1) // BLOCK_BYTES))


def grid(edges: DataFrame, vectors: DataFrame) -> tuple[int, int]:
    """Blocks of sources, and parts of targets, so that no cell has many more than CELL_EDGES edges. The edges are read twice."""
    n = max(_blocks(vectors.where("v is not null")), -(-edges.count() // CELL_EDGES))
    full = edges.where("src is not null").groupBy(_block(F.col("src").cast("long"), n).alias("block")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return n, -(-full // CELL_EDGES) or 1


def product(edges: DataFrame, vectors: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """node, v: for each dst node the sum of its src nodes' vectors times the edges' weights. edges: src, dst, weight; vectors: node, v (equally long), each node once.

    Edges from nodes without a vector add nothing, and nodes without such edges give no row. Repeated edges add again. Null ends, weights and vectors take no part. shape: as grid()
    gives it, for edges that are multiplied several times.
    """
    ends = edges.where("src is not null and dst is not null and weight is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    slim = vectors.where("node is not null and v is not null").select(F.col("node").cast("long").alias("node"), "v")
    n, parts = shape or grid(ends, slim)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table(np.zeros(0, np.int64), np.zeros((0, 1)))
        nodes, x = right["node"].to_numpy(), rows_of(right["v"])
        order = np.argsort(nodes, kind="stable")
        nodes, x = nodes[order], x[order]
        src, dst, weight = (left[c].to_numpy() for c in ("src", "dst", "weight"))
        at = np.minimum(np.searchsorted(nodes, src), len(nodes) - 1)
        known = np.flatnonzero(nodes[at] == src)
        known = known[np.argsort(dst[known], kind="stable")]
        out = []
        for lo in range(0, len(known), CHUNK):
            k = known[lo : lo + CHUNK]
            start = np.flatnonzero(np.diff(dst[k], prepend=dst[k[0]] - 1))
            out.append((dst[k][start], np.add.reduceat(x[at[k]] * weight[k][:, None], start)))
        if not out:
            return _table(np.zeros(0, np.int64), np.zeros((0, 1)))
        return _table(*(np.concatenate(y) for y in zip(*out, strict=True)))

    cells = ends.withColumns({"block": _block("src", n), "part": _block("dst", parts)}).groupBy("block", "part")
    dealt = slim.withColumns({"block": _block("node", n), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))}).groupBy("block", "part")
    return add_up(cells.cogroup(dealt).applyInArrow(multiply, OUT), n)


def over_lists(lists: DataFrame | Lists, each: Callable[[np.ndarray, np.ndarray], tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """query_id and the columns that each(nodes, vectors) gives, list by list, nodes in order. lists: query_id, node (long), v. Lists lie side by side in their tasks, many in a batch; a
    list, with its query and candidates, is bounded. Of Lists, whose cands are nodes with v, each is worked on where it lies."""
    sql = {pa.int64(): "long", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
    if isinstance(lists, Lists):
        return _over_folded(lists, each, names, kinds, sql)
    kind = lists.schema["query_id"].dataType.simpleString()

    def run(batches):
        held = []

        def flush(table: pa.Table, last: bool):
            """Lists that have ended, and the rows of the last one if it may go on."""
            ids = table["query_id"].combine_chunks().dictionary_encode("encode")
            ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy(zero_copy_only=False)
            edge = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            keep = len(ids) if last else edge[-2]
            nodes, x = table["node"].to_numpy(), rows_of(table["v"])
            at, out = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi <= keep:
                    found = each(nodes[lo:hi], x[lo:hi])
                    at.append(np.full(len(found[0]), lo))
                    out.append(found)
            done = None
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                done = pa.RecordBatch.from_arrays(
                    [table["query_id"].combine_chunks().take(pa.array(np.concatenate(at))), *(arrays(c) if c.ndim == 2 else pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["query_id", *names])
            return done, table.slice(keep)

        for b in batches:
            if not len(b):
                continue
            done, rest = flush(pa.Table.from_batches([*held, b]), False)
            held = rest.combine_chunks().to_batches()
            if done is not None:
                yield done
        if held:
            yield flush(pa.Table.from_batches(held), True)[0]

    slim = lists.where("v is not null").select("query_id", F.col("node").cast("long").alias("node"), "v")
    ordered = slim.repartition("query_id").sortWithinPartitions("query_id", "node")
    return ordered.mapInArrow(run, ", ".join([f"query_id {kind}", *(f"{c} {sql[t]}" for c, t in zip(names, kinds, strict=True))]))


def _over_folded(lists: Lists, each, names: list[str], kinds: list[pa.DataType], sql: dict) -> DataFrame:
    def work(block: Block) -> pa.RecordBatch:
        nodes, x, lo, at, out = block.cands["node"].to_numpy(zero_copy_only=False), block.rows("v"), 0, [], []
        for k, n in enumerate(block.size):
            own, v = nodes[lo : lo + n], x[lo : lo + n]
            lo += n
            order = np.argsort(own, kind="stable")
            order = order[~np.isnan(v[order]).any(axis=1)]
            if len(order):
                found = each(own[order], v[order])
                at.append(np.full(len(found[0]), k))
                out.append(found)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros((0, 1) if pa.types.is_list(t) else 0) for t in kinds]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([block.batch["query_id"].take(pa.array(at)), *(arrays(c) if c.ndim == 2 else pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["query_id", *names])

    kind = lists.rows.schema["query_id"].dataType.simpleString()
    return over_blocks(lists, work, ", ".join([f"query_id {kind}", *(f"{c} {sql[t]}" for c, t in zip(names, kinds, strict=True))]))
