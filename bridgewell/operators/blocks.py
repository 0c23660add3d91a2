"""Vectors in packed blocks with bounds, and exact nearest items over a grid of query blocks and item blocks.

Vectors near the same pivot and of like length share a block, which knows its centre, its radius and its least and largest length. No inner product of two
blocks exceeds the product of their largest lengths, nor that of the centres and what the radii allow; no distance is below what centres and radii, or
lengths, leave. A pair of blocks whose bound misses what the queries have already found in a sample is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

BLOCK, PIVOTS, SAMPLE = 2048, 256, 4096  # vectors of a block; vectors that name cells; items that give queries their first floors
GROUP = 1024  # blocks whose bounds are compared at once
ROOM = 1e-8  # relative room for rounding


def rows_of(column) -> np.ndarray:
    """Equally long lists without nulls as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def some(vectors: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most so many rows, those of the smallest hashes. vectors: id, x."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return got["id"].to_numpy(), rows_of(got["x"]) if len(got) else np.zeros((0, 0))


def similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Inner products, or squared distances below zero: higher is nearer."""
    s = q @ x.T
    return s if metric == "ip" else 2 * s - (x * x).sum(axis=1) - (q * q).sum(axis=1)[:, None]


def floors(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> np.ndarray:
    """What k of the items x reach for each query; less than any score with fewer items."""
    if len(x) < k:
        return np.full(len(q), -np.inf)
    largest, out = (x * x).sum(axis=1).max(), [np.zeros(0)]
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        s = similarity(part, x, metric)
        room = ROOM * (1 + np.abs(s).max(axis=1)) + 1e-12 * ((part * part).sum(axis=1) + largest)  # products of long vectors round more
        out.append(np.partition(s, len(x) - k, axis=1)[:, len(x) - k] - room)
    return np.concatenate(out)


def _floats(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


SUMMARY = ["block", "centre", "radius", "least", "most", "floor"]
KINDS = "block long, n int, centre binary, radius double, least double, most double, floor double, ids binary, x binary, floors binary"


def packed(vectors: DataFrame, pivots: np.ndarray, size: int = BLOCK, known: np.ndarray | None = None, k: int = 0, metric: str = "ip") -> DataFrame:
    """Blocks of at most `size` vectors (id, x), as rows of KINDS. known: items that give each vector its floor, as for queries; a column `floor` gives floors known
    before. Rows are ordered by cell, length and id over ranges of like size, so that a full cell lies in many tasks and blocks."""
    vectors = vectors if "floor" in vectors.columns else vectors.withColumn("floor", F.lit(float("-inf")))
    sent = vectors.sparkSession.sparkContext.broadcast((pivots, known))  # PIVOTS and SAMPLE vectors

    def place(batches):
        p = sent.value[0]
        for b in batches:
            x = rows_of(b["x"])
            cell = np.concatenate([np.zeros(0, np.int64), *(similarity(x[i : i + 4096], p, "l2").argmax(axis=1) for i in range(0, len(x), 4096))])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.sqrt((x * x).sum(axis=1))), b["id"], b["x"], b["floor"]], ["cell", "length", "id", "x", "floor"])

    def block(number: int, ids: np.ndarray, x: np.ndarray, given: np.ndarray) -> pa.RecordBatch:
        centre, length = x.mean(axis=0), np.sqrt((x * x).sum(axis=1))
        least = np.maximum(floors(x, sent.value[1], k, metric), given) if sent.value[1] is not None else np.zeros(0)
        values = (number, len(ids), _floats(centre), float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), float(length.min()), float(length.max()), float(least.min(initial=np.inf)), ids.astype("<i8").tobytes(), _floats(x), _floats(least))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), *[pa.float64()] * 4, *[pa.binary()] * 3), strict=True)], [c.split()[0] for c in KINDS.split(", ")])

    def gather(batches):
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            cells, ids, x, given = b["cell"].to_numpy(), b["id"].to_numpy(), rows_of(b["x"]), b["floor"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                at = lo
                if held and held[0][0] != cells[lo]:
                    yield block(number, *(np.concatenate(y) for y in list(zip(*held, strict=True))[1:]))
                    number, held = number + 1, []
                while at < hi:
                    take = min(hi - at, size - sum(len(h[1]) for h in held))
                    held.append((cells[lo], ids[at : at + take], x[at : at + take], given[at : at + take]))
                    at += take
                    if sum(len(h[1]) for h in held) == size:
                        yield block(number, *(np.concatenate(y) for y in list(zip(*held, strict=True))[1:]))
                        number, held = number + 1, []
        if held:
            yield block(number, *(np.concatenate(y) for y in list(zip(*held, strict=True))[1:]))

    order = ["cell", "length", "id"]
    ordered = vectors.mapInArrow(place, f"cell int, length double, id long, {vectors.select('x').schema.simpleString()[7:-1].replace(':', ' ', 1)}, floor double").repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.mapInArrow(gather, KINDS))


def reach(q: np.ndarray, q_radius, q_least, q_most, c: np.ndarray, radius, least, most, metric: str) -> np.ndarray:
    """The most that a member of each query block (or a query, of radius 0) and one of each item block can score."""
    if metric == "ip":
        lengths = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((c * c).sum(axis=1))
        ball = q @ c.T + lengths[0] * radius + q_radius[:, None] * (lengths[1] + radius)
        bound = np.minimum(ball, q_most[:, None] * most)
    else:
        away = np.sqrt(np.maximum(-similarity(q, c, "l2"), 0)) - q_radius[:, None] - radius
        bound = -np.maximum(np.maximum(away, 0), np.maximum(q_least[:, None] - most, least - q_most[:, None])) ** 2
    return bound + ROOM * (1 + np.abs(bound))


def _summaries(blocks: DataFrame, name: str, other: str, n: int, m: int) -> DataFrame:
    """Bounds of the blocks in n groups, each once for each of the m groups of the other side."""
    groups = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias(name), F.struct(*SUMMARY).alias("s")).groupBy(name).agg(F.collect_list("s").alias(f"{name}_s"))  # about GROUP blocks
    return groups.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def block_pairs(queries: DataFrame, items: DataFrame, metric: str) -> DataFrame:
    """q_block, block: the pairs of blocks that bounds do not rule out, compared group by group over a grid of groups."""
    n, m = (max(1, -(-b.count() // GROUP)) for b in (queries, items))

    def side(column: pa.Array):
        s = column.values
        get = lambda c: s.field(c).to_numpy(zero_copy_only=False)
        return get("block"), np.frombuffer(b"".join(s.field("centre").to_pylist())).reshape(len(s), -1), get("radius"), get("least"), get("most"), get("floor")

    def compare(batches):
        for b in batches:
            for i in range(len(b)):
                q, x = side(b["q_s"].slice(i, 1)), side(b["i_s"].slice(i, 1))
                at, to = np.nonzero(reach(*q[1:5], *x[1:5], metric) >= q[5][:, None])
                yield pa.RecordBatch.from_pydict({"q_block": pa.array(q[0][at]), "block": pa.array(x[0][to])})

    grid = _summaries(queries, "q", "i", n, m).join(_summaries(items, "i", "q", m, n), ["q", "i"])
    return grid.select("q_s", "i_s").mapInArrow(compare, "q_block long, block long")


def grid_top(queries: DataFrame, items: DataFrame, k: int, metric: str, nearest, size: int = BLOCK) -> DataFrame:
    """query_id, item_id, score (higher is nearer): of each query what can be among its k best. queries, items: id, x; queries may tell a score
    that k items reach as `floor`. Queries travel to the item blocks that their own
    bounds leave; an item block is shuffled once."""
    _, pivots = some(items, PIVOTS)
    if not len(pivots):
        return items.sparkSession.createDataFrame([], "query_id long, item_id long, score double")
    _, known = some(items, SAMPLE)
    q_blocks, blocks = packed(queries, pivots, size, known, k, metric), packed(items, pivots, size)

    def choose(batches):
        """Queries of a block whose own bound leaves the item block."""
        for b in batches:
            for r in b.to_pylist():
                x, floor, ids = np.frombuffer(r["q_x"]).reshape(r["q_n"], -1), np.frombuffer(r["q_floors"]), np.frombuffer(r["q_ids"], "<i8")
                length = np.sqrt((x * x).sum(axis=1))
                c = np.frombuffer(r["centre"])[None]
                at = np.flatnonzero(reach(x, np.zeros(len(x)), length, length, c, *(np.array([r[n]]) for n in ("radius", "least", "most")), metric)[:, 0] >= floor)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]]), "q_ids": pa.array([ids[at].tobytes()]), "q_x": pa.array([_floats(x[at])]), "q_floors": pa.array([_floats(floor[at])])})

    def meet(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, x = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                found = nearest(q, np.frombuffer(r["q_x"]).reshape(len(q), -1), x, np.frombuffer(r["x"]).reshape(len(x), -1), k, metric)
                floor = np.frombuffer(r["q_floors"])
                order = np.argsort(q, kind="stable")
                kept = found[2] >= floor[order][np.searchsorted(q[order], found[0])]
                yield pa.RecordBatch.from_arrays([pa.array(f[kept]) for f in found], ["query_id", "item_id", "score"])

    asked = q_blocks.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("floors").alias("q_floors"))
    pairs = block_pairs(q_blocks, blocks, metric).join(blocks.select("block", "centre", "radius", "least", "most"), "block").join(asked, "q_block")
    left = pairs.mapInArrow(choose, "block long, q_ids binary, q_x binary, q_floors binary")
    return left.join(blocks.select("block", "ids", "x"), "block").mapInArrow(meet, "query_id long, item_id long, score double")
