"""Approximate nearest neighbours by inner product with an inverted multi-index.

Both halves of a vector are quantised apart; a cell is a pair of centroids. For a query, cells are visited in the order of the
summed scores of its halves with the centroids, by a heap over the sorted pairs, until enough entries are met; these
are reranked exactly on the original vectors. Equal vectors are one entry with their smallest ids, so that a vector that
a third of the rows hold costs no more than another.

Two bounds save work and change no result. The (k+1)-th best of the sampled entries that a query visits can't lie above the k-th best of all
others that it visits, so what scores less is dropped where it is met; and a cell whose radii show that nothing in it can score as much is passed over.

Cells lie together in buckets of about PART entries, a larger cell in several. A query goes to each bucket it visits once, with the numbers
of its cells there; the queries of a bucket are dealt to groups of about as many.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import saved

FIT_ROWS = 20_000  # vectors on which the codebooks are fitted, those whose hashed ids come first
BOUND_ROWS = 4096  # of these, the ones that bound a query's k-th score
RECALL = 0.93  # of the nearest entries of the trial queries that the search must meet
TRIALS = 192  # queries that are answered in full to set how far the search goes
CELL, MOST_CENTROIDS = 50, 2048  # wanted entries of a cell; centroids of a half at most (cells then grow beyond 200 million vectors)
PART = 4096  # entries of a bucket, and queries that meet them in one group


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means; starts from distinct rows of a seeded order."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def traverse(a: np.ndarray, b: np.ndarray, count, enough: int) -> list[int]:
    """Cells (i * len(b) + j) by falling a[i] + b[j] until their entries are enough; empty ones are passed over.

    The heap holds one pair for each centroid of the first half that has been reached, so no pair is met twice.
    """
    oa, ob, width = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist(), len(b)
    sa, sb = (-a[oa]).tolist(), (-b[ob]).tolist()
    heap, out, have = [(sa[0] + sb[0], 0, 0)], [], 0
    while heap and have < enough:
        _, i, j = heap[0]
        cell = oa[i] * width + ob[j]
        if n := count[cell]:
            out.append(cell)
            have += n
        if j + 1 < width:
            heapq.heapreplace(heap, (sa[i] + sb[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def reach(a: np.ndarray, b: np.ndarray, count: np.ndarray, wanted: list[int]) -> list[int]:
    """Entries that a query must look at for each of the wanted cells to be met."""
    met, have = {}, 0
    for c in traverse(a, b, count, int(count.sum())):
        met[c] = have + 1
        have += int(count[c])
    return [met[c] for c in wanted]


def _matrix(column) -> np.ndarray:
    """Equally long lists without nulls as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of vectors; that of a single component has a second half of zeros."""
    half = max(1, x.shape[1] // 2)
    return x[:, :half], x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))


def place(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each vector, and how far its halves lie from their centroids."""
    near = [nearest(h, b) for h, b in zip(halves(x), books, strict=True)]
    off = [np.linalg.norm(h - b[n], axis=1) for h, b, n in zip(halves(x), books, near, strict=True)]
    return (near[0] * len(books[1]) + near[1], *off)


@dataclass
class Index:
    """Codebooks of both halves, what the cells hold, and where they lie."""

    books: tuple[np.ndarray, np.ndarray]
    sample: np.ndarray  # entries that bound a query's k-th score
    count: np.ndarray | None = None  # entries of each cell
    sample_cell: np.ndarray | None = None
    radius: tuple[np.ndarray, np.ndarray] | None = None  # of each centroid: how far its entries lie from it at most
    first: np.ndarray | None = None  # bucket of each cell, or the first of several
    parts: np.ndarray | None = None  # buckets of each cell

    def fill(self, count: np.ndarray, radius: tuple[np.ndarray, np.ndarray], part: int = PART) -> None:
        self.count, self.radius, self.parts = count, radius, np.maximum(1, -(-count // part))
        self.sample_cell = place(self.sample, self.books)[0]
        self.first, at, have = np.zeros(len(count), np.int64), 0, 0
        for c in np.flatnonzero(count).tolist():  # cells in order; a bucket is closed when it is full
            n = int(count[c])
            if have and have + n > part:
                at, have = at + 1, 0
            self.first[c] = at
            if n > part:
                at, have = at + int(self.parts[c]), 0
            else:
                have += n

    def visits(self, x: np.ndarray, enough: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x and cells: what each query visits, without the cells that can't hold one of its k best there; and for
        each query a score that the k-th best reaches among the entries visited, the query itself left out."""
        y, z = halves(x)
        a, b, width = y @ self.books[0].T, z @ self.books[1].T, len(self.books[1])
        count, met = memoryview(np.ascontiguousarray(self.count)), np.zeros(len(self.count), bool)
        least, rows, out = np.full(len(x), -np.inf), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        far = np.linalg.norm(self.sample, axis=1).max()
        for i in range(len(x)):
            c = np.array(traverse(a[i], b[i], count, enough), np.int64)
            met[c] = True
            s = self.sample[met[self.sample_cell]] @ x[i]
            met[c] = False
            if len(s) > k:
                least[i] = np.partition(s, len(s) - 1 - k)[len(s) - 1 - k] - 1e-9 * (1 + far * np.linalg.norm(x[i]))  # room for rounding
            most = a[i][c // width] + b[i][c % width] + np.linalg.norm(y[i]) * self.radius[0][c // width] + np.linalg.norm(z[i]) * self.radius[1][c % width]
            c = c[most >= least[i]]
            out.append(c)
            rows.append(np.full(len(c), i))
        return np.concatenate(rows), np.concatenate(out), least


def _ranked(query: np.ndarray, score: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's best rows, ties to the smaller name."""
    order = np.lexsort((name, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(start, np.diff([*start, len(q)])) < most]


def rerank(found: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """Hits of the queries of a group among the entries of a bucket: the k + 1 best ids that reach the query's least score."""
    hits = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    query = asking["query"].to_numpy()
    if len(found) and len(asking):
        x, q, least = _matrix(found["v"]), _matrix(asking["q"]), asking["least"].to_numpy()
        lists, cells = found["ids"].combine_chunks(), asking["cells"].combine_chunks()
        ids, id_at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        cell, order = found["cell"].to_numpy(), np.argsort(found["cell"].to_numpy(), kind="stable")
        wanted, who = cells.flatten().to_numpy(), np.repeat(np.arange(len(q)), cells.value_lengths().to_numpy())
        by = np.argsort(wanted, kind="stable")
        wanted, who, cell = wanted[by], who[by], cell[order]
        for c in np.unique(wanted):
            e = order[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
            w = who[np.searchsorted(wanted, c) : np.searchsorted(wanted, c, "right")]
            for lo in range(0, len(w) if len(e) else 0, 512):
                i, j = np.nonzero(q[w[lo : lo + 512]] @ x[e].T >= least[w[lo : lo + 512], None])
                i, j = w[lo + i], e[j]
                exact = (x[j] * q[i]).sum(axis=1)
                n = id_at[j + 1] - id_at[j]
                at = np.repeat(id_at[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
                hits.append((np.repeat(i, n), np.repeat(exact, n), ids[at]))
    who, score, name = (np.concatenate(h) for h in zip(*hits, strict=True))
    best = _ranked(who, score, name, k + 1)
    return pa.Table.from_arrays([pa.array(query[who[best]]), pa.array(score[best]), pa.array(name[best])], ["query", "score", "vec_id"])


def _entries(clean: DataFrame, k: int) -> DataFrame:
    """entry (its number), v and its k + 1 smallest ids, for each distinct vector."""
    first = Window.partitionBy("v").orderBy("id")
    least = clean.groupBy("v", "id").agg(F.lit(1)).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    return saved(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "v", "ids"))


def _sample(rows: DataFrame, name: str, seed: int, most: int) -> pa.Table:
    return rows.orderBy(F.xxhash64(F.lit(seed), name), name).limit(most).toArrow()


def _enough(placed: DataFrame, asked: DataFrame, index: Index, k: int, recall: float) -> int:
    """Entries that queries must look at to meet that share of the nearest entries of trial queries, which are compared with all."""
    trial = _sample(asked.groupBy("entry").agg(F.first("v").alias("v")), "entry", 9, TRIALS)
    if not len(trial):
        return 1
    q, own = _matrix(trial["v"]), trial["entry"].to_numpy()

    def full(batches):
        for batch in batches:
            s = q @ _matrix(batch["v"]).T
            s[own[:, None] == batch["entry"].to_numpy()[None, :]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), top.shape[1])), pa.array(np.take_along_axis(s, top, 1).ravel()), batch["cell"].take(pa.array(top.ravel()))], ["trial", "score", "cell"])

    near = placed.select("entry", "v", "cell").mapInArrow(full, "trial long, score double, cell int")
    best_of = Window.partitionBy("trial").orderBy(F.desc("score"), "cell")
    by: dict[int, list[int]] = {}
    for r in near.where("score > double('-infinity')").withColumn("_n", F.row_number().over(best_of)).where(F.col("_n") <= k).collect():  # TRIALS x k rows
        by.setdefault(r["trial"], []).append(r["cell"])
    y, z = halves(q)
    needs = [n for t, cells in by.items() for n in reach(y[t] @ index.books[0].T, z[t] @ index.books[1].T, index.count, cells)]
    return int(np.quantile(needs, recall, method="higher")) if needs else 1


def search(vectors: DataFrame, asks: Column, k: int = 20, candidates: int | None = None, recall: float = RECALL, fit_rows: int = FIT_ROWS, cell: int = CELL, part: int = PART, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (double). For each row that satisfies `asks`, the k nearest other
    rows found by inner product, nearest first, ties to the smaller id; all, if there are fewer.

    candidates: distinct vectors that a query looks at; by default as many as bring the wanted recall on TRIALS
    queries, which are compared with every entry. Never fewer than k + 1, so that a query finds k rows where there are k.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most (ties: the longer)
    take no part, nor do rows with a null id. A repeated id counts once for each distinct vector and has a list for each as a query; a query never finds its own
    id, so that one whose id stands at other vectors too may find fewer than k rows.
    Other columns are left out; no rows give no rows.
    """
    spark, v = vectors.sparkSession, F.col(vector)
    sound = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    clean = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    size = clean.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = size[0]["n"]
    clean = clean.where(F.size("v") == dims)
    entries = _entries(clean, k)
    rows, kind = entries.count(), entries.schema["v"].dataType.simpleString()
    asked = saved(clean.where("asks").select("id", "v").distinct().join(entries.select("entry", "v"), "v"))

    fit = _matrix(_sample(entries.select("entry", "v"), "entry", 5, fit_rows)["v"])
    n = int(min(MOST_CENTROIDS, max(1, round((rows / cell) ** 0.5))))
    index = Index(tuple(centroids(x, n) for x in halves(fit)), fit[:BOUND_ROWS])
    width = len(index.books[1])
    books = spark.sparkContext.broadcast(index.books)  # bounded by MOST_CENTROIDS

    def put(batches):
        for batch in batches:
            cell, off_a, off_b = place(_matrix(batch["v"]), books.value)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("entry", "v", "ids")), pa.array(cell.astype(np.int32)), pa.array(off_a), pa.array(off_b)], ["entry", "v", "ids", "cell", "off_a", "off_b"])

    placed = saved(entries.mapInArrow(put, f"entry long, v {kind}, ids array<long>, cell int, off_a double, off_b double"))
    filled = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off_a").alias("a"), F.max("off_b").alias("b")).toArrow()  # MOST_CENTROIDS squared rows at most
    at, count = filled["cell"].to_numpy(), np.zeros(len(index.books[0]) * width, np.int64)
    count[at] = filled["n"].to_numpy()
    radius = np.zeros(len(index.books[0])), np.zeros(width)
    np.maximum.at(radius[0], at // width, filled["a"].to_numpy())
    np.maximum.at(radius[1], at % width, filled["b"].to_numpy())
    index.fill(count, radius, part)
    enough = max(k + 1, candidates if candidates is not None else _enough(placed, asked, index, k, recall))
    sent = spark.sparkContext.broadcast(index)  # bounded by MOST_CENTROIDS squared cells and BOUND_ROWS vectors

    def visit(batches):
        ix = sent.value
        for batch in batches:
            q = _matrix(batch["v"])
            row, cells, least = ix.visits(q, enough, k)
            parts = ix.parts[cells]
            row, cells, bucket = np.repeat(row, parts), np.repeat(cells, parts), np.repeat(ix.first[cells], parts)
            bucket += np.arange(len(bucket)) - np.repeat(np.cumsum(parts) - parts, parts)
            order = np.lexsort((row, bucket))
            row, cells, bucket = row[order], cells[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])) if len(row) else np.zeros(0, np.int64)
            who = pa.array(row[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[new].astype(np.int32)), batch["entry"].take(who), batch["v"].take(who), pa.array(least[row[new]]), pa.ListArray.from_arrays(pa.array([*new, len(row)], pa.int32()), pa.array(cells.astype(np.int32)))],
                ["bucket", "query", "q", "least", "cells"])

    def deal(batches):
        ix = sent.value
        for batch in batches:
            cells = batch["cell"].to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("cell", "v", "ids")), pa.array((ix.first[cells] + batch["entry"].to_numpy() % ix.parts[cells]).astype(np.int32))], ["cell", "v", "ids", "bucket"])

    asking = asked.groupBy("entry").agg(F.first("v").alias("v"))
    probes = saved(asking.mapInArrow(visit, f"bucket int, query long, q {kind}, least double, cells array<int>"))
    groups = probes.groupBy("bucket").agg(F.ceil(F.count("*") / part).cast("int").alias("groups"))
    dealt = placed.select("entry", "cell", "v", "ids").mapInArrow(deal, f"cell int, v {kind}, ids array<long>, bucket int").join(groups, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("block"), "cell", "v", "ids")
    to = probes.join(groups, "bucket").select("bucket", F.pmod(F.xxhash64("query"), "groups").cast("int").alias("block"), "query", "q", "least", "cells")
    hits = dealt.groupBy("bucket", "block").cogroup(to.groupBy("bucket", "block")).applyInArrow(lambda x, y: rerank(x, y, k), "query long, score double, vec_id long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    named = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query")).join(hits, "query").where("query_id <> vec_id")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
