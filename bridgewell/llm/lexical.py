"""Ranked lexical search by term owners in a pipeline.

The documents are cut into blocks where they lie; a block keeps, of each asked term, the documents that hold it and how often. The asked terms are dealt to
owners, rarest first, so that each owner has about as many postings. Items travel in bundles: for each block a bundle carries the sparse accumulators
of its items (documents and integer scores so far). At each stage the bundles meet one owner's postings of their block by cogroup, and the
contributions are added; after the last owner the best are selected.

Scores only grow, so between stages a document is left out of an accumulator once its score and all that later owners can add stay below the item's
known floor: a score that k documents have reached already, read from a histogram over all blocks. Where later owners' terms alone cannot reach the floor, no new
documents are taken in. What is left out cannot be among the k best, so results are whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .interpolation import written
from .resampling import IS_TERM

K, OWNERS, FLOOR, SLOPE = 50, 4, 50, 50  # best documents; owners of terms; a document's m is FLOOR plus SLOPE times its relative length
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096  # text and documents of a block
GROUP_ITEMS, GROUP_BYTES, BUNDLE = 1024, 4 << 20, 32  # items and text searched in one run; items of a bundle
STEPS = 32  # histogram cells for each doubling of a score


@dataclass
class Asked:
    """The items of one run: distinct terms by code, and the codes of each item."""

    ids: list
    terms: list[bytes]
    codes: list[np.ndarray]
    bundle: int = BUNDLE

    def __post_init__(self):
        self.data = np.frombuffer(b"".join(self.terms) + bytes(W.PADDING), np.uint8)
        ends = np.cumsum([len(t) for t in self.terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in self.terms], np.int64)
        self.seed = 0
        while len(np.unique(h := W.xxh64(self.data, starts, ends, self.seed))) < len(h):
            self.seed += 1
        self.order = np.argsort(h)
        self.hashes, self.start, self.end = h[self.order], starts[self.order], ends[self.order]

    @staticmethod
    def of(rows: list[tuple[object, str | None]], bundle: int = BUNDLE) -> Asked:
        """Rows of one id are one item."""
        b, by = W.Block([(t or "").encode() for _, t in rows], IS_TERM, lower=True), defaultdict(set)
        raw = b.bytes.tobytes()
        for (i, _), lo, hi in zip(rows, b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
            by[i] |= {raw[s:e] for s, e in zip(b.start[lo:hi].tolist(), b.end[lo:hi].tolist(), strict=True)}
        terms = sorted(set().union(*by.values()))
        code = {t: k for k, t in enumerate(terms)}
        ids = list(by)
        return Asked(ids, terms, [np.array(sorted(code[t] for t in by[i]), np.int64) for i in ids], bundle)

    def find(self, b: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """Which words of the block are asked for, and their codes."""
        if not len(self.terms) or not len(b.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = W.xxh64(b.bytes, b.start, b.end, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        at = at[hit]
        same = W.same_bytes(b.bytes, b.start[hit], b.end[hit], self.data, self.start[at], self.end[at])
        return hit[same], self.order[at[same]]


INDEX = "block long, doc_ids array<long>, sizes binary, codes array<int>, counts array<int>, most array<int>, docs binary, times binary"


def _blocks(batches, asked: Asked, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids and sizes of its documents, and by term how many hold it, how often at most, which ones and how often."""
    number, held = (TaskContext.get().partitionId() << 32), []

    def flush():
        nonlocal number
        codes, docs, sizes, first = [], [], [], 0
        for lo, hi in W.pieces(texts := [t for _, t in held]):
            b = W.Block(texts[lo:hi], IS_TERM, lower=True)
            hit, code = asked.find(b)
            codes.append(code)
            docs.append(b.text_of[hit] + lo)
            sizes.append(np.diff(b.first))
        code, doc, n = (np.concatenate(x).astype(np.int64) for x in (codes, docs, sizes))
        pairs, times = np.unique(code * len(held) + doc, return_counts=True)
        term, first, count = np.unique(pairs // len(held), return_index=True, return_counts=True)
        most = np.maximum.reduceat(times, first) if len(first) else first
        lists = [pa.array([x], t) for x, t in (([i for i, _ in held], pa.list_(pa.int64())), (n.astype("<i4").tobytes(), pa.binary()), (term, pa.list_(pa.int32())), (count, pa.list_(pa.int32())), (most, pa.list_(pa.int32())), ((pairs % len(held)).astype("<u2").tobytes(), pa.binary()), (times.astype("<i4").tobytes(), pa.binary()))]
        row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], [x.split()[0] for x in INDEX.split(", ")])
        number, held[:] = number + 1, []
        return row

    size = 0
    for b in batches:
        for i, t in zip(b["doc_id"].to_pylist(), W.as_bytes(b["text"]), strict=True):
            if held and (size + len(t) > BLOCK_BYTES or len(held) == most):
                yield flush()
                size = 0
            held.append((i, t))
            size += len(t)
    if held:
        yield flush()


@dataclass
class Plan:
    """What all tasks know of a run: items, weights and owners of terms, the corpus's size, and by owner what later owners can add to an item."""

    asked: Asked
    weight: np.ndarray
    owner: np.ndarray
    documents: int
    words: int
    rest: np.ndarray  # (owner, item)

    def parts(self, sizes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        m = FLOOR + (SLOPE * sizes.astype(np.int64) * self.documents) // max(1, self.words)
        times = times.astype(np.int64)
        return (1_000_000_000 * times) // (1000 * times + 20 * m[docs])


def _summed(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches):
        for b in batches:
            sizes = [np.frombuffer(x, "<i4") for x in b["sizes"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"documents": pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), "words": pa.array([int(s.sum(dtype=np.int64)) for s in sizes], pa.int64())})

    r = index.select("sizes").mapInArrow(count, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    return r[0] or 0, r[1] or 0


def plan(index: DataFrame, asked: Asked, owners: int = OWNERS) -> Plan:
    """Weights by document frequencies over all blocks, owners by like shares of all postings. A row for each asked term reaches the driver."""
    n = len(asked.terms)
    df, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_term = index.select(F.explode(F.arrays_zip("codes", "counts", "most")).alias("t")).groupBy("t.codes").agg(F.sum("t.counts").alias("df"), F.max("t.most").alias("most"))
    for r in by_term.collect():
        df[r.codes], most[r.codes] = r.df, r.most
    documents, words = _summed(index)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.argsort(df, kind="stable")
    owner = np.zeros(n, np.int64)
    owner[order] = np.minimum((np.cumsum(df[order]) - df[order]) * owners // max(1, int(df.sum())), owners - 1)
    bound = weight * ((1_000_000_000 * most) // (1000 * most + 20 * FLOOR))
    rest = np.array([[int(bound[c[owner[c] > s]].sum()) for c in asked.codes] for s in range(owners)], np.int64).reshape(owners, len(asked.ids))
    return Plan(asked, weight, owner, documents, words, rest)


@dataclass
class Sparse:
    """Accumulators of a bundle: for each item, documents of the block in order and their scores."""

    docs: list[np.ndarray]
    scores: list[np.ndarray]

    @staticmethod
    def unpack(sizes: bytes | None, docs: bytes, scores: bytes, items: int) -> Sparse:
        if sizes is None:
            return Sparse([np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items)
        cut = np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]
        return Sparse(np.split(np.frombuffer(docs, "<u2").astype(np.int64), cut), np.split(np.frombuffer(scores, "<i8"), cut))

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return np.array([len(d) for d in self.docs], "<i4").tobytes(), np.concatenate(self.docs).astype("<u2").tobytes(), np.concatenate(self.scores).astype("<i8").tobytes()


CARRIED = "block long, bundle int, sizes binary, docs binary, scores binary, cells binary"
FOUND = "item int, doc_id long, score long"


def _cell(score: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(score)).astype(np.int64)


def _add(run: Plan, stage: int, last: bool, k: int, floor: np.ndarray, block: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """One block at one owner: its bundles with the owner's contributions added, or the best documents of each item after the last owner."""
    row = {c: right[c][0].as_py() for c in right.column_names if c != "block"}
    sizes = np.frombuffer(row["sizes"], "<i4")
    codes, counts = np.array(row["codes"], np.int64), np.array(row["counts"], np.int64)
    docs = np.frombuffer(row["docs"], "<u2").astype(np.int64)
    part = run.parts(sizes, docs, np.frombuffer(row["times"], "<i4"))
    end = np.cumsum(counts)
    where = {c: slice(e - n, e) for c, n, e in zip(codes.tolist(), counts.tolist(), end.tolist(), strict=True)}
    ids = np.array([-(1 << 63) if i is None else i for i in row["doc_ids"]], np.int64) if last else None
    out, rest, n_items = [], run.rest[stage], len(run.asked.ids)
    for bundle, was_sizes, was_docs, was_scores in zip(*(left[c].to_pylist() for c in ("bundle", "sizes", "docs", "scores")), strict=True):
        items = range(bundle * run.asked.bundle, min(n_items, (bundle + 1) * run.asked.bundle))
        was, now, cells = Sparse.unpack(was_sizes, was_docs, was_scores, len(items)), Sparse([], []), []
        for i, d, s in zip(items, was.docs, was.scores, strict=True):
            acc = np.zeros(len(sizes), np.int64)
            own = [c for c in run.asked.codes[i].tolist() if c in where]
            for c in own:
                acc[docs[where[c]]] += run.weight[c] * part[where[c]]
            if stage and run.rest[stage - 1][i] < floor[i]:  # what this and later owners add stays below: no new documents
                s = s + acc[d]
            else:
                acc[d] += s
                d = np.flatnonzero(acc)
                s = acc[d]
            least = max(int(floor[i]), int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else 0)
            kept = s + rest[i] >= least
            d, s = d[kept], s[kept]
            if last:
                best = np.lexsort((ids[d], -s))[:k]
                out.append((np.full(len(best), i), d[best], s[best]))
            else:
                now.docs.append(d)
                now.scores.append(s)
                top = np.partition(s, len(s) - k)[len(s) - k :] if len(s) > k else s
                cell, n = np.unique(_cell(top), return_counts=True)
                cells.append(np.stack([np.full(len(cell), i), cell, n], axis=1))
        if not last:
            out.append((bundle, *now.pack(), np.concatenate(cells).astype("<i4").tobytes()))
    if last:
        item, d, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True))
        found = pa.array(ids[d], pa.int64(), mask=ids[d] == -(1 << 63))
        return pa.Table.from_arrays([pa.array(item, pa.int32()), found, pa.array(s, pa.int64())], ["item", "doc_id", "score"])
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([block] * len(out), pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], [c.split()[0] for c in CARRIED.split(", ")])


def _floors(carried: DataFrame, k: int, n_items: int) -> np.ndarray:
    """A score that k documents of an item have reached already: the edge of a histogram cell, summed over all blocks. A row for each item reaches the driver."""

    def cells(batches):
        for b in batches:
            x = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(c, "<i4").reshape(-1, 3) for c in b["cells"].to_pylist())])
            key, where = np.unique(x[:, 0] << 32 | x[:, 1], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"item": pa.array(key >> 32, pa.int64()), "cell": pa.array(key & 0xFFFFFFFF, pa.int64()), "n": pa.array(np.bincount(where, weights=x[:, 2], minlength=len(key)).astype(np.int64))})

    n = carried.select("cells").mapInArrow(cells, "item long, cell long, n long").groupBy("item", "cell").agg(F.sum("n").alias("n"))
    reached = n.withColumn("above", F.sum("n").over(Window.partitionBy("item").orderBy(F.desc("cell")))).where(F.col("above") >= k).groupBy("item").agg(F.max("cell").alias("cell"))
    out = np.zeros(n_items, np.int64)
    for r in reached.collect():
        out[r.item] = max(0, math.floor(2 ** (r.cell / STEPS)) - 1 - (int(2 ** (r.cell / STEPS)) >> 40))  # below the cell's edge, whatever the rounding
    return out


def _slices(index: DataFrame, run, stage: int, last: bool) -> DataFrame:
    """Of each block the postings of one owner's terms."""
    names = ["block", "sizes", "codes", "counts", "docs", "times", *(["doc_ids"] if last else [])]

    def cut(batches):
        owner = run.value.owner
        for b in batches:
            out = {c: [] for c in names}
            for r in b.to_pylist():
                codes, counts = np.array(r["codes"], np.int64), np.array(r["counts"], np.int64)
                own = owner[codes] == stage
                each = np.repeat(own, counts)
                r |= {"codes": codes[own], "counts": counts[own], "docs": np.frombuffer(r["docs"], "<u2")[each].tobytes(), "times": np.frombuffer(r["times"], "<i4")[each].tobytes()}
                for c in names:
                    out[c].append(r[c])
            kinds = {"block": pa.int64(), "codes": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "doc_ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.binary())) for c in names], names)

    return index.select(*names).mapInArrow(cut, index.select(*names).schema)


def _adding(known, stage: int, last: bool, k: int, floor: np.ndarray):
    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _add(known.value, stage, last, k, floor, key[0].as_py(), left, right)

    return meet


def _search(docs: DataFrame, asked: Asked, k: int, owners: int, block_docs: int) -> DataFrame:
    """item (place in asked.ids), doc_id, score: the k best of each block that can be among the k best."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(asked)  # GROUP_BYTES of text at most
    index = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _blocks(batches, sent.value, block_docs), INDEX))
    run = plan(index, asked, owners)
    known, n_items = spark.sparkContext.broadcast(run), len(asked.ids)
    bundles = -(-n_items // asked.bundle)
    carried = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "docs", "scores")])
    floor = np.zeros(n_items, np.int64)
    for stage in range(owners):
        last = stage == owners - 1
        slices = _slices(index, known, stage, last).groupBy("block")
        met = carried.groupBy("block").cogroup(slices).applyInArrow(_adding(known, stage, last, k, floor), FOUND if last else CARRIED)
        if last:
            return met
        carried = written(met)
        floor = _floors(carried, k, n_items)
        carried = carried.drop("cells").mapInArrow(lambda batches, stage=stage, floor=floor: _pruned(batches, known.value, stage, floor), CARRIED.rsplit(", ", 1)[0])
    raise ValueError("at least one owner")


def _pruned(batches, run: Plan, stage: int, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bundles without the documents that can no longer reach their item's floor."""
    size, rest = run.asked.bundle, run.rest[stage]
    for b in batches:
        out = {c: [] for c in b.schema.names}
        for r in b.to_pylist():
            items = range(r["bundle"] * size, min(len(floor), (r["bundle"] + 1) * size))
            s = Sparse.unpack(r["sizes"], r["docs"], r["scores"], len(items))
            kept = [x + rest[i] >= floor[i] for i, x in zip(items, s.scores, strict=True)]
            s = Sparse([d[m] for d, m in zip(s.docs, kept, strict=True)], [x[m] for x, m in zip(s.scores, kept, strict=True)])
            for c, v in zip(out, (r["block"], r["bundle"], *s.pack()), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, b.schema.field(c).type) for c, v in out.items()], schema=b.schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, block_docs: int = BLOCK_DOCS, bundle: int = BUNDLE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k documents of each item with the highest scores above 0, ties to the smaller doc_id.

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z lowered. A null or empty text has none; an item without terms, or with none that
    documents hold, gives no rows; rows of one item_id (null included) are one item, with the terms of all its texts. Repeated documents count and rank each;
    one without an id counts, and ranks before others of its score. doc_id is an integer, item_id of any type. A very long text is a block of its own. Empty tables give no rows; other
    columns are left out. Items are searched group_items or GROUP_BYTES of text at a time, as many times as that takes.
    """
    spark = docs.sparkSession
    some = items.select("item_id", "text")
    size = some.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size.n // group_items), -(-size.b // GROUP_BYTES))
    kind, out = some.schema["item_id"].dataType, None
    for g in range(groups):
        own = some if groups == 1 else some.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        asked = Asked.of([(r.item_id, r.text) for r in own.collect()], bundle)  # about GROUP_BYTES
        if not asked.ids:
            continue
        found = _search(docs, asked, k, owners, block_docs)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(asked.ids)], f"item int, item_id {kind.simpleString()}")
        named = found.join(F.broadcast(names), "item").drop("item")  # group_items rows
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.where("score > 0").withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
