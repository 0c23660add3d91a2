"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their segments. Two fingerprints within
the radius have counts that differ by no more than the radius in all, so other pairs of tiles are skipped; the
remaining pairs are compared whole with exclusive-or and bit counts. A pair of tiles yields a spanning forest of its
links, which keeps every component and stays linear in the tile's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import memory
from . import words as W
from .components import components, saved

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE = 2048  # fingerprints of a tile; fuller ones are cut
#: The bits of a byte, each in a lane of eight bits, first bit lowest.
LANES = np.array([sum(1 << (8 * k) for k in range(8) if v >> k & 1) for v in range(256)], np.uint64)


def fingerprint_block(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for n, t in enumerate(texts):
        words = t.lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces part words
        if not words:
            continue
        k = min(shingle, len(words))
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        stop = ends[k - 1 :].tolist()
        begin = [0, *(ends[: len(words) - k] + 1).tolist()]
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(begin, stop, strict=True)], np.uint64)
        lanes = LANES[h.view(np.uint8).reshape(-1, 8)]
        parts = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
        counts = parts.view(np.uint8).reshape(len(parts), 64).sum(axis=0, dtype=np.int64)
        out[n] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (long) of every row. A null or empty text has fingerprint zero; a text of fewer words
    than a shingle is one shingle; other columns are left out; no rows give no rows."""

    def run(batches):
        for b in batches:
            got = fingerprint_block(W.as_bytes(b["text"]), shingle)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fingerprint": pa.array(got.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs of a and b within the radius."""
    def near():
        for lo in range(0, len(a), 512):
            i, j = np.nonzero(np.bitwise_count(a[lo : lo + 512, None] ^ b[None, :]) <= radius)
            yield lo + i, j

    return _join(a, b, near())


def _join(a: np.ndarray, b: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (row of a, row of b)."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, of_a, of_b, out = np.arange(len(nodes)), where[: len(a)], where[len(a) :], []
    for i, j in near:
        cut = np.flatnonzero(np.diff(i)) + 1
        for rows, others in zip(np.split(i, cut), np.split(j, cut), strict=True):
            if not len(rows):
                continue
            own = label[of_a[rows[0]]]
            ls, at = np.unique(label[of_b[others]], return_index=True)
            for other, k in zip(ls, at, strict=True):
                if other != own:
                    out.append((int(a[rows[0]]), int(b[others[k]])))
                    label[label == other] = own
    return out


def segments_for(rows: int) -> int:
    """Segments of a tile's signature: more for more rows, so that the compared share falls as rows grow."""
    return next(s for s, most in ((2, 1 << 19), (4, 1 << 25), (8, 1 << 33), (16, 1 << 70)) if rows < most)


def links(distinct: DataFrame, radius: int = RADIUS, segments: int | None = None, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of fingerprints within the radius, enough to join every two that a chain of such pairs joins.

    distinct: one column `fingerprint`, each value once, not null. segments: into how many parts the signature cuts a fingerprint; any number gives the
    same links.
    """
    segments = segments or segments_for(distinct.count())
    width = 64 // segments
    base = width + 1 + 2 * radius  # room for every step, so that a step beyond the counts meets no tile
    bits = [F.bit_count(F.shiftrightunsigned("fingerprint", i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]
    signature = sum(((c + radius).cast("long") * base**i for i, c in enumerate(bits)), F.lit(0).cast("long"))
    marked = distinct.select("fingerprint", signature.alias("signature"))
    sizes = marked.groupBy("signature").agg(F.ceil(F.count("*") / tile).alias("cuts"))
    tiles = saved(marked.join(sizes, "signature").groupBy("signature", F.pmod(F.xxhash64("fingerprint"), "cuts").alias("cut")).agg(F.collect_list("fingerprint").alias("prints")))
    steps = F.array(*[F.lit(sum(d * base**i for i, d in enumerate(m))).cast("long") for m in _moves(radius, segments)])
    met = sizes.select(F.col("signature").alias("s_a"), F.col("cuts").alias("cuts_a"), F.explode(steps).alias("step")).withColumn("s_b", F.col("s_a") + F.col("step")).join(
        sizes.select(F.col("signature").alias("s_b"), F.col("cuts").alias("cuts_b")), "s_b")
    # pairs of tiles by name first: each tile then meets its partners in a place of its own, so that those of the densest signature are dealt out
    met = met.withColumn("c_a", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1))).withColumn("c_b", F.explode(F.sequence(F.lit(0), F.col("cuts_b") - 1))).where("step <> 0 or c_a <= c_b")
    of = lambda n: tiles.select(F.col("signature").alias(f"s_{n}"), F.col("cut").alias(f"c_{n}"), F.col("prints").alias(n))
    pairs = met.select("s_a", "c_a", "s_b", "c_b").join(of("a"), ["s_a", "c_a"]).join(of("b"), ["s_b", "c_b"]).select("a", "b")

    def compare(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                found += _forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
            got = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return pairs.mapInArrow(compare, "a long, b long")


def _moves(radius: int, segments: int) -> list[tuple[int, ...]]:
    """Changes of the counts within the radius, one of each opposite two."""
    found = {(0,) * segments}
    for _ in range(radius):
        found |= {m[:i] + (m[i] + d,) + m[i + 1 :] for m in found for i in range(segments) for d in (-1, 1)}
    return sorted(m for m in found if m >= (0,) * segments and sum(map(abs, m)) <= radius)


SALT, MOST_PARTS = 256, 1 << 16  # rows of a key that meet in one place, and places of a key at most
MOST_SENT = 1 << 20  # rows that are broadcast at most


def parts_of(rows: Column) -> Column:
    return F.least(F.ceil(rows / SALT), F.lit(MOST_PARTS)).cast("int").alias("parts")


def rejoined(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """many joined with few, which has one row for each key of many, with `parts`: a key of many rows is dealt to so many places by doc_id, and its row of
    few goes to each."""
    few = saved(few)
    hot = few.where("parts > 1").select(key, "parts")
    n = hot.limit(MOST_SENT + 1).count()
    if not n:
        return many.join(few.drop("parts"), key)
    spread = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = many.join(F.broadcast(hot) if n <= MOST_SENT else hot, key, "left").withColumn("_part", F.pmod(F.xxhash64("doc_id", key), F.coalesce("parts", F.lit(1))).cast("int"))
    return dealt.drop("parts").join(spread, [key, "_part"]).drop("_part")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links, itself included.

    Equal fingerprints are linked, empty texts among them. A repeated row appears again; a row with a null doc_id
    is left out; no rows give no rows.
    """
    return _linked(saved(fingerprints(docs.where("doc_id is not null"), shingle)), radius, segments).select("doc_id", "fingerprint", "component_id")


def _linked(prints: DataFrame, radius: int, segments: int | None) -> DataFrame:
    """prints (saved: doc_id, fingerprint and more) with component_id."""
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), parts_of(F.count("*")))
    linked = components(links(groups.select("fingerprint"), radius, segments).distinct())
    joined = linked.join(groups, linked["node"] == groups["fingerprint"]).select("node", "component", "least")
    least = joined.groupBy("component").agg(F.min("least").alias("least_all"))
    merged = joined.join(least, "component").select(F.col("node").alias("fingerprint"), "least_all")
    roots = groups.join(merged, "fingerprint", "left").select("fingerprint", F.coalesce("least_all", "least").alias("component_id"), "parts")
    return rejoined(prints, roots, "fingerprint")


def first_of_linked(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component of near_duplicates(), that with the smallest id. Null ids, repeated rows and rows of one id are treated as by
    keep_first()."""

    def run(batches):
        for b in batches:
            got = fingerprint_block(W.as_bytes(b["text"]), shingle)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(got.view(np.int64))], ["doc_id", "text_key", "fingerprint"])

    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return _without(docs, _linked(saved(keyed.mapInArrow(run, "doc_id long, text_key long, fingerprint long")), radius, None))


# Similar documents: pairs that share one of their rarest shingles, judged by the exact similarity of their shingle sets.
SIMILARITY, SIMILAR_SHINGLE = 0.8, 5
SAMPLE, SAMPLE_EVERY, MOST_COMMON = 4_000, 12, 1_000_000  # the documents that tell which shingles are common: so many, or one in so many if that is more; and how many shingles are named
POSTINGS = 2048  # of a shingle's documents, in a chain
BIG, TILE_SETS = 64, 512  # documents of a shingle from which on they are compared by tiles, and sets of a tile
SLOTS = 1 << 26  # bits that tell which documents need a check


def shingle_sets(texts: list[bytes], shingle: int = SIMILAR_SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles. A text of fewer words than a shingle is one shingle."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for lo, hi in W.pieces(texts):
        b = W.Block(texts[lo:hi], lower=True)
        runs = W.Windows(b.hashes())
        for i, n in enumerate(np.diff(b.first).tolist()):
            if n:
                k = min(shingle, n)
                out[lo + i] = np.unique(runs.at(np.arange(b.first[i], b.first[i + 1] - k + 1), k))
    return out


def _node(s: np.ndarray) -> int:
    """A set's own number, a hash of its members."""
    return int(W.mix(np.array([W.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first members of a set, rare ones before common ones: so many that two sets that similar share one of theirs."""
    if not len(s):
        return s
    level = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        level = np.where(common[at] == s, often[at], 0)
    return s[np.argsort(level, kind="stable")[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]]


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, sorted, and in how many. They set the order of a set's members alone:
    which pairs are found does not depend on them."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(W.as_bytes(b["text"]), shingle)]).view(np.int64))})

    every = min(SAMPLE_EVERY, max(1, rows.count() // SAMPLE))
    counted = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    got = counted.where("n > 2").orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    h, n = got["shingle"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _need(similarity: float, x: str, y: str):
    """Members that sets of these sizes must share."""
    return (F.col(x) + F.col(y)) * F.lit(similarity / (1 + similarity)) - 1e-9


def _possible(similarity: float):
    """Whether two postings a_ and b_ can be the first shared shingle of sets that similar: by their sizes, and what follows in each."""
    sizes = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(similarity) - 1e-9
    left = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    return sizes & (left >= _need(similarity, "a_size", "b_size"))


def _sets(need: DataFrame, rows: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """node and members (binary) of the nodes needed, each once. named: node and the id of a row that has its set."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    word = named.join(need, "node", "left_semi").select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    wanted = np.zeros(SLOTS // 64, np.uint64)
    wanted[word["word"].to_numpy()] = word["bits"].to_numpy().view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(wanted)  # SLOTS bits: texts of other ids are passed over and nothing but the sets is shuffled

    def run(batches):
        for b in batches:
            at = b["slot"].to_numpy()
            b = b.filter(pa.array((sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            sets = shingle_sets(W.as_bytes(b["text"]), shingle)
            yield pa.RecordBatch.from_pydict({"node": pa.array([_node(s) for s in sets], pa.int64()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})
        memory.trim()

    return rows.select(slot, "text").mapInArrow(run, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


def _checked(pairs: DataFrame, rows: DataFrame, named: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are that similar."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(need, rows, named, shingle)  # one shuffle, which both joins read

    def compare(batches):
        for b in batches:
            near = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(near, pa.bool_()))
        memory.trim()

    half = pairs.join(sets, pairs["a"] == sets["node"]).select("a", "b", F.col("members").alias("x"))
    both = half.join(sets, half["b"] == sets["node"]).select("a", "b", "x", F.col("members").alias("y"))
    return both.mapInArrow(compare, "a long, b long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a shares with each of b, by products of indicator matrices over the members that both sides hold."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, every), len(both) - 1)
        hit = both[at] == every
        return row[hit], at[hit]

    sides = [places(a), places(b)] if len(both) else []
    for lo in range(0, len(both), 4096):
        left, right = (np.zeros((len(x), 4096), np.float32) for x in (a, b))
        for m, (row, at) in zip((left, right), sides, strict=True):
            on = (at >= lo) & (at < lo + 4096)
            m[row[on], at[on] - lo] = 1
        out += left @ right.T
    return out


def _tiled(big: DataFrame, rows: DataFrame, named: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) between documents of one group, groups being joined by the shingles of many documents: tiles of whole sets are compared exactly, and
    a pair of tiles yields a spanning forest of its links between components. big: shingle, node, size, component.

    Tiles hold sets of one band of sizes; those of the group's main component lie apart and are not compared with one another, so that a large group
    costs the product of its rows and those outside that component.
    """
    lows = big.groupBy("shingle").agg(F.min("node").alias("low"))
    groups = components(big.join(lows, "shingle").select(F.col("node").alias("a"), F.col("low").alias("b")))
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / np.log(1 / similarity) if similarity < 1 else F.col("size").cast("double")).cast("int")
    members = big.groupBy("node").agg(F.first("size").alias("size"), F.first("component").alias("component")).join(groups.withColumnRenamed("component", "grp"), "node")
    most = members.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    members = saved(members.join(most, "grp").select("grp", "node", "component", band.alias("band"), (F.col("component") == F.col("main")).cast("int").alias("main")))
    parts = saved(members.groupBy("grp", "band", "main").agg(F.ceil(F.count("*") / TILE_SETS).cast("int").alias("parts")))
    tile = members.join(parts, ["grp", "band", "main"]).select("grp", "band", "main", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "component")
    side = lambda x: parts.select("grp", *[F.col(c).alias(f"{c}_{x}") for c in ("band", "main", "parts")])
    near = side("a").withColumn("band_b", F.explode(F.array(F.col("band_a"), F.col("band_a") + 1))).join(side("b"), ["grp", "band_b"]).where(
        "not (main_a = 1 and main_b = 1) and (band_a < band_b or main_a <= main_b)")
    met = near.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1))).where(
        "band_a < band_b or main_a < main_b or part_a <= part_b")
    ends = F.array(F.struct(F.lit(0).alias("side"), *[F.col(f"{c}_a").alias(c) for c in ("band", "main", "part")]), F.struct(F.lit(1).alias("side"), *[F.col(f"{c}_b").alias(c) for c in ("band", "main", "part")]))
    keys = ["grp", "band_a", "main_a", "part_a", "band_b", "main_b", "part_b"]
    sent = met.select(*keys, F.explode(ends).alias("e")).select(F.xxhash64(*keys).alias("meeting"), "grp", "e.side", "e.band", "e.main", "e.part")
    sets = tile.join(_sets(members.select("node"), rows, named, shingle), "node")

    def compare(group: pa.Table) -> pa.Table:
        side, node, component = group["side"].to_numpy(), group["node"].to_numpy(), group["component"].to_numpy()
        member = [np.frombuffer(x, np.uint64) for x in group["members"].to_pylist()]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = np.zeros((0, 2), np.uint64)
        if len(a) and len(b):
            both = _overlaps([member[k] for k in a], [member[k] for k in b])
            size = np.array([len(m) for m in member])
            close = (both >= similarity * (size[a][:, None] + size[b][None, :] - both) - 1e-9) & (component[a][:, None] != component[b][None, :])
            found = np.array(_join(node[a].view(np.uint64), node[b].view(np.uint64), [np.nonzero(close)]), np.uint64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])

    return sets.join(sent, ["grp", "band", "main", "part"]).select("meeting", "side", "node", "component", "members").groupBy("meeting").applyInArrow(compare, "a long, b long")


def similar_links(rows: DataFrame, nodes: DataFrame, named: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets are that similar, enough to join every two that a chain of such pairs joins.

    nodes: node, size, prefix (binary), named: node, doc_id, one row each; rows: doc_id, text. What one step joins is not compared again.
    First, documents that follow one another in a seeded order of each shingle of the prefixes; second, all documents of a shingle with the one that has most
    links so far; so a large group of near copies mostly costs its rows. Third, all other pairs of a shingle of few documents, without those that share
    too few: of two prefixes the one that ends first holds every shingle shared up to there, so that a pair shares at most the shingles
    common to both prefixes and what follows one of them. Last, documents of a shingle of over BIG documents, by tiles.
    """

    def spread(batches):
        for b in batches:
            got = [np.frombuffer(x, np.int64) for x in b["prefix"].to_pylist()]
            n = [len(x) for x in got]
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(x) for x in n]])
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([np.zeros(0, np.int64), *got])), "node": pa.array(np.repeat(b["node"].to_numpy(), n)),
                "place": pa.array(np.repeat(b["size"].to_numpy().astype(np.int64) << 32, n) | at)})

    postings = nodes.select("node", "size", "prefix").mapInArrow(spread, "shingle long, node long, place long")
    held = postings.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(postings.join(held, "shingle").select("shingle", "node", "place", "n"))
    shared = shared.select("shingle", "node", F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "n")
    side = lambda d, name, *more: d.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "size", "at", *more)])
    ends = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")]

    cuts = F.ceil(F.col("n") / POSTINGS).cast("int")
    order = Window.partitionBy("shingle", "_cut").orderBy(F.xxhash64(F.lit(1), "shingle", "a_node"), "a_node")
    cut = side(shared.withColumn("_cut", F.pmod(F.xxhash64("shingle", "node"), cuts).cast("int")), "a", "n", "_cut").withColumnRenamed("a__cut", "_cut")
    next_ = cut.select("*", *[F.lag(f"a_{c}").over(order).alias(f"b_{c}") for c in ("node", "size", "at")]).where("b_node is not null")
    beside = saved(next_.groupBy(*ends).agg(F.max(_possible(similarity)).alias("possible"), F.count_if(F.col("a_n") == 2).alias("twos")).where("a <> b"))
    first = saved(_checked(beside.where("possible").select("a", "b"), rows, named, similarity, shingle))

    def apart(links: DataFrame) -> DataFrame:
        """Postings of shingles that stand in several components, with these."""
        placed = shared.where("n > 2").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
        return saved(placed.join(several, "shingle"))

    rest = apart(first)
    degree = first.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    hub = rest.join(degree, "node", "left").groupBy("shingle").agg(F.max(F.struct(F.coalesce("links", F.lit(0)), "node", "size", "at", "component")).alias("h")).select(
        "shingle", *[F.col(f"h.{c}").alias(f"b_{c}") for c in ("node", "size", "at", "component")])
    spokes = side(rest, "a", "component").join(hub, "shingle").where("a_component <> b_component").where(_possible(similarity)).select(*ends).distinct()
    second = saved(_checked(saved(spokes.join(beside.where("possible"), ["a", "b"], "left_anti")), rows, named, similarity, shingle))

    rest = apart(first.union(second))
    few = rest.where(F.col("n") <= BIG)
    met = side(few, "a", "component").join(side(few, "b", "component"), "shingle").where("a_node < b_node and a_component <> b_component")
    counted = met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_size", "b_size").agg(F.count("*").alias("c"), F.max(_possible(similarity)).alias("possible"))
    follow = F.greatest(*[F.ceil(F.col(c) * F.lit(similarity) - 1e-9) - 1 for c in ("a_size", "b_size")])
    all_ = F.col("c") + F.coalesce("twos", F.lit(0))  # of these shingles and of those that the two alone have; pairs of a shingle of many documents come last
    pairs = counted.where("possible").join(beside.withColumnRenamed("possible", "tried"), ["a", "b"], "left").where((all_ + follow >= _need(similarity, "a_size", "b_size")) & ~F.coalesce("tried", F.lit(False))).select("a", "b")
    found = first.union(second).union(_checked(saved(pairs), rows, named, similarity, shingle))

    big = rest.where(F.col("n") > BIG).select("shingle", "node", "size", "component")
    return found if big.isEmpty() else found.union(_tiled(big, rows, named, similarity, shingle))


def _similar(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """doc_id, text_key (a hash of the text, which tells the rows of a repeated id apart) and component_id of the rows whose id is not null."""
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(_common(rows, shingle))  # bounded by MOST_COMMON

    def name(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array([_node(s) for s in shingle_sets(W.as_bytes(b["text"]), shingle)], pa.int64())], ["doc_id", "text_key", "node"])

    def run(batches):
        for b in batches:
            sets = shingle_sets(W.as_bytes(b["text"]), shingle)
            yield pa.RecordBatch.from_pydict({"node": pa.array([_node(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int32()),
                "prefix": pa.array([prefix(s, similarity, *sent.value).tobytes() for s in sets], pa.binary())})
        memory.trim()

    prints = saved(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(name, "doc_id long, text_key long, node long"))
    named = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), parts_of(F.count("*")))
    nodes = rows.select("text").mapInArrow(run, "node long, size int, prefix binary").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    found = components(similar_links(rows, nodes, named.select("node", "doc_id"), similarity, shingle))
    least = named.withColumnRenamed("doc_id", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id", "parts")
    return rejoined(prints, roots, "node").select("doc_id", "text_key", "component_id")


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links between documents whose shingle sets have that
    Jaccard similarity or more. No pair is missed: shingles are compared by 64-bit hashes, and nothing else is estimated.

    Null and empty texts have no shingles and are linked to one another; a text of any length is one set. Equal sets are compared once. A row with
    a null doc_id is left out; repeated rows appear again; no rows give no rows.
    """
    return _similar(docs, similarity, shingle).select("doc_id", "component_id")


def _without(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """docs without the rows that linked (doc_id, text_key, component_id) names by another document than their own."""
    found = saved(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct())
    few = found.limit(MOST_SENT + 1).count() <= MOST_SENT
    gone = F.broadcast(found) if few else found
    return docs.join(gone, (docs["doc_id"] == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """docs with one document of each component of similar ones, that with the smallest id. Rows with a null id are kept, as are repeated
    rows of the id that stays; of rows with one id and several texts each is judged by its own text. The columns stay."""
    return _without(docs, _similar(docs, similarity, shingle))
