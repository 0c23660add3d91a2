"""Media columns: chroma audio fingerprints and their alignment.

Samples become frames of twelve pitch classes; filters over rectangles of the frames, read off an integral image,
each give two bits, so that every frame start yields a packed 32-bit integer. Recordings are aligned by histograms of the
offsets at which they share integers; the best offset is judged by the share of differing bits. Integers also meet by chance, where two recordings have a few notes in
common; such an alignment has few equal integers and many differing bits, while a true one under noise loses integers but differs in few bits, so that either many
equal integers or few differing bits are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import saved

RATE, FRAME, HOP = 4000, 1024, 512  # samples a second, samples of a frame, samples between frames
SPAN = 12  # frames that an integer sees
LEAST_HZ, MOST_HZ = 110.0, 1760.0
MIN_HITS, MAX_ERROR = 4, 0.3  # of shared integers; of differing bits
MIN_SHARE, SURE_ERROR = 0.15, 0.15  # shared integers in the overlap, asked for where more than this share of bits differs
BUNDLE, MEETINGS = 1 << 21, 1 << 20  # integers of the queries that go to every task at once, about; equal integers looked at together in a task
#: Sixteen filters: (kind, first pitch class, pitch classes, first frame, frames); kinds halve their rectangle: 0 not at all, 1 by pitch, 2 by time, 3 both ways.
FILTERS = [(n % 4, (5 * n) % 9, 4 if n % 3 else 2, (7 * n) % 5, 4 + n % 4 * 2 if n % 4 * 2 + 4 + (7 * n) % 5 <= SPAN else 4) for n in range(16)]
STEPS = (-0.12, 0.0, 0.12)  # bounds between the four values of a filter
QUIET = 1e-4  # mean square below which a frame is silent


@lru_cache(maxsize=8)
def _classes(rate: int, frame: int) -> np.ndarray:
    """Frequency bin x pitch class, with 1 where the bin's nearest note is of the class."""
    f = np.arange(frame // 2 + 1) * rate / frame
    out = np.zeros((len(f), 12))
    on = np.flatnonzero((f >= LEAST_HZ) & (f <= MOST_HZ))
    out[on, np.round(12 * np.log2(f[on] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames x 12, each of unit length; silent frames are zero. Fewer samples than a frame give none."""
    if len(samples) < frame:
        return np.zeros((0, 12))
    x = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(x * np.hanning(frame), axis=1)) ** 2 @ _classes(rate, frame)
    norm = np.sqrt((power * power).sum(axis=1, keepdims=True))
    return np.where(((x * x).mean(axis=1) > QUIET)[:, None] & (norm > 0), power / np.maximum(norm, 1e-30), 0.0)


def integers(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each run of SPAN frames; runs of silence alone give 0."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t: int, p: int, dt: int, dp: int) -> np.ndarray:
        a, b = at + t, at + t + dt
        return (image[b, p + dp] - image[a, p + dp] - image[b, p] + image[a, p]) / (dt * dp)

    out = np.zeros(n, np.uint32)
    for kind, p, dp, t, dt in FILTERS:
        hp, ht = dp // 2, dt // 2
        if kind == 0:
            v = area(t, p, dt, dp) - area(0, 0, SPAN, 12)
        elif kind == 1:
            v = area(t, p, dt, hp) - area(t, p + hp, dt, dp - hp)
        elif kind == 2:
            v = area(t, p, ht, dp) - area(t + ht, p, dt - ht, dp)
        else:
            v = (area(t, p, ht, hp) + area(t + ht, p + hp, dt - ht, dp - hp) - area(t, p + hp, ht, dp - hp) - area(t + ht, p, dt - ht, hp)) / 2
        level = np.searchsorted(STEPS, v).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))  # neighbours differ by one bit
    silent = image[at + SPAN, 12] == image[at, 12]
    out[silent] = 0
    return out


def fingerprints(media: DataFrame, decode: Callable[[pa.RecordBatch], Iterator[np.ndarray]], key: str = "rec_id") -> DataFrame:
    """key and prints (array<int>) of every row. decode: the samples of each row of a batch, as floats from -1 to 1; None for a row
    without sound. Null or short media have no prints; other columns are left out; no rows give no rows."""

    def run(batches):
        for b in batches:
            rows = [np.zeros(0, np.uint32) if x is None else integers(chroma(x)) for x in decode(b)]
            yield pa.RecordBatch.from_pydict({key: b[key], "prints": pa.array([r.view(np.int32) for r in rows], pa.list_(pa.int32()))})

    return media.mapInArrow(run, f"{key} long, prints array<int>")


def from_pcm(column: str = "pcm") -> Callable:
    """Decoder of a binary column of little-endian signed 16-bit samples."""

    def decode(batch: pa.RecordBatch):
        for x in batch[column].to_pylist():
            yield None if x is None else np.frombuffer(x[: len(x) // 2 * 2], "<i2") / 32768.0

    return decode


class Prints:
    """Integers of some recordings one after another: flat (0 for null), known (False for null), the first place and the number of each recording."""

    def __init__(self, ids: pa.Array, prints: pa.Array):
        self.ids = ids.to_numpy(zero_copy_only=False)
        flat = prints.flatten()
        self.known = flat.is_valid().to_numpy(zero_copy_only=False)
        self.flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
        self.size = pc.list_value_length(prints).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.append(0, np.cumsum(self.size))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each integer that votes: its recording, its place there and itself."""
        at = np.flatnonzero(self.flat)
        rec = np.searchsorted(self.start, at, "right") - 1
        return rec, at - self.start[rec], self.flat[at]


class Index(Prints):
    """Queries with their integers in order: the key of a place is its integer's code times the number of queries, plus its query."""

    def __init__(self, ids: pa.Array, prints: pa.Array):
        super().__init__(ids, prints)
        rec, place, v = self.places()
        self.values, code = np.unique(v, return_inverse=True)
        key = code * len(self.ids) + rec
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]

    def between(self, code: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of places at which the queries from lo to hi hold each of these integers: its begin and its length."""
        n = len(self.ids)
        begin = np.searchsorted(self.key, code * n + lo)
        return begin, np.searchsorted(self.key, code * n + hi) - begin


def _ranges(n: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose numbers add up to `most` or fewer; one that exceeds it stands alone."""
    total, lo, out = np.cumsum(n), 0, []
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def _expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, n of each, one run after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _best(pair: np.ndarray, offset: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The places of each pair's offset with the most hits, ties to the smallest offset."""
    order = np.lexsort((offset, -hits, pair))
    return order[np.flatnonzero(np.diff(pair[order], prepend=-1))]


def best_offsets(index: Index, others: Prints, min_hits: int, most: int = MEETINGS) -> np.ndarray:
    """Rows of query, recording, offset, hits (queries and recordings by number): the offset at which both share most integers, min_hits at least. Equal integers are looked at `most` at a
    time: recordings side by side, or else the queries of one recording side by side, or else the places of one recording and one query."""
    rec, place, v = others.places()
    code = np.minimum(np.searchsorted(index.values, v), max(0, len(index.values) - 1))
    met = index.values[code] == v if len(index.values) else np.zeros(len(v), bool)
    rec, place, code = rec[met], place[met], code[met]
    out = [np.zeros((0, 4), np.int64)]

    def count(at: slice, lo: int, hi: int):
        begin, n = index.between(code[at], lo, hi)
        if int(n.sum()) <= most:
            got = _expanded(begin, n)
            pair = np.repeat(rec[at], n) * len(index.ids) + index.key[got] % len(index.ids)
            offset = np.repeat(place[at], n) - index.place[got]
            if len(offset):
                low = int(offset.min())
                wide = int(offset.max()) - low + 1
                both, hits = np.unique(pair * wide + (offset - low), return_counts=True)
                keep(both // wide, both % wide + low, hits)
        elif rec[at][0] != rec[at][-1]:
            edges = np.flatnonzero(np.diff(rec[at], prepend=-1, append=-1)) + at.start
            for a, b in _ranges(np.add.reduceat(n, edges[:-1] - at.start), most):
                count(slice(int(edges[a]), int(edges[b])), lo, hi)
        elif hi - lo > 1:
            count(at, lo, (lo + hi) // 2)
            count(at, (lo + hi) // 2, hi)
        else:
            hits = np.zeros(int(place[at].max()) + int(index.size[lo]) + 1, np.int64)
            shift = int(index.size[lo])
            for a, b in _ranges(n, most):
                got = _expanded(begin[a:b], n[a:b])
                hits += np.bincount(np.repeat(place[at][a:b], n[a:b]) - index.place[got] + shift, minlength=len(hits))
            some = np.flatnonzero(hits)
            keep(np.full(len(some), int(rec[at][0]) * len(index.ids) + lo), some - shift, hits[some])

    def keep(pair: np.ndarray, offset: np.ndarray, hits: np.ndarray):
        enough = hits >= min_hits
        pair, offset, hits = pair[enough], offset[enough], hits[enough]
        k = _best(pair, offset, hits)
        out.append(np.stack([pair[k] % len(index.ids), pair[k] // len(index.ids), offset[k], hits[k]], axis=1))

    if len(rec):
        count(slice(0, len(rec)), 0, len(index.ids))
    return np.concatenate(out)


def differing(index: Prints, others: Prints, found: np.ndarray, most: int = MEETINGS) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of best_offsets(): the integers that overlap, and the share of their bits that differ; not a number where one is null."""
    a, b, offset = found[:, 0], found[:, 1], found[:, 2]
    start_a, start_b = np.maximum(0, -offset), np.maximum(0, offset)
    overlap = np.minimum(index.size[a] - start_a, others.size[b] - start_b)
    bits = np.zeros(len(found))
    for lo, hi in _ranges(overlap, most):
        n = overlap[lo:hi]
        x, y = _expanded(index.start[a[lo:hi]] + start_a[lo:hi], n), _expanded(others.start[b[lo:hi]] + start_b[lo:hi], n)
        unlike = np.bitwise_count((index.flat[x] ^ others.flat[y]).view(np.uint32)).astype(np.float64)
        unlike[~(index.known[x] & others.known[y])] = np.nan
        bits[lo:hi] = np.add.reduceat(unlike, np.cumsum(n) - n)
    return overlap, bits / (overlap * 32)


def align(
    asked: DataFrame, known: DataFrame, min_hits: int = MIN_HITS, max_error: float = MAX_ERROR, min_share: float = MIN_SHARE, sure_error: float = SURE_ERROR,
    bundle: int = BUNDLE, most: int = MEETINGS,
) -> DataFrame:
    """query_id, rec_id, copies, offset, hits, error: recordings of `known` that share at least min_hits integers with a query at their best offset and differ in at most
    max_error of the overlap's bits there; where more than sure_error of them differ, min_share of the overlap's integers must be shared.

    Both tables: rec_id, prints. Recordings with equal prints form one class, named by its smallest rec_id, of `copies` rows; a query
    meets its own class too. offset: place in the recording less place in the query, in frames; equal counts: the smallest.
    Zero integers (silence) vote for nothing but are compared. Null ids or prints and empty ones match nothing. Prints of any length are compared
    whole; a very long recording is one row.

    Queries go to every task in bundles of about `bundle` integers, and recordings are judged where they lie: equal integers are counted in the tasks and not joined as rows. Their number
    grows as that of queries times that of recordings, since integers meet by chance.
    """
    sound = "rec_id is not null and prints is not null and size(prints) > 0"
    classes = saved(known.where(sound).groupBy("prints").agg(F.min("rec_id").alias("rec_id"), F.countDistinct("rec_id").alias("copies")))
    asks = saved(asked.where(sound).groupBy("prints").agg(F.min("rec_id").alias("ask")))
    bundles = -(-(asks.agg(F.sum(F.size("prints"))).first()[0] or 1) // bundle)

    def judged(k: int) -> DataFrame:
        part = asks.where(F.pmod(F.xxhash64("ask"), F.lit(bundles)) == k).select("ask", "prints").toArrow().combine_chunks()
        sent = asks.sparkSession.sparkContext.broadcast([pa.concat_arrays(part[c].chunks) if part[c].num_chunks else pa.array([], part[c].type) for c in ("ask", "prints")])  # about `bundle` integers

        def run(batches):
            index = Index(*sent.value)
            for b in batches:
                for lo, hi in _ranges(pc.list_value_length(b["prints"]).to_numpy(zero_copy_only=False).astype(np.int64), most):
                    some = b.slice(lo, hi - lo)
                    others = Prints(some["rec_id"], some["prints"])
                    found = best_offsets(index, others, min_hits, most)
                    overlap, error = differing(index, others, found, most)
                    good = (error <= max_error) & ((error <= sure_error) | (found[:, 3] >= min_share * overlap))
                    found = found[good]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(index.ids[found[:, 0]], pa.int64()), pa.array(others.ids[found[:, 1]], pa.int64()), some["copies"].take(pa.array(found[:, 1])),
                        pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3]), pa.array(error[good])], ["ask", "rec_id", "copies", "offset", "hits", "error"])

        return classes.select("rec_id", "copies", "prints").mapInArrow(run, "ask long, rec_id long, copies long, offset int, hits long, error double")

    met = reduce(DataFrame.unionByName, [judged(k) if bundles == 1 else saved(judged(k)) for k in range(bundles)])
    names = asked.where(sound).select(F.col("rec_id").alias("query_id"), "prints").distinct().join(asks, "prints").select("query_id", "ask")
    return names.join(met, "ask").select("query_id", "rec_id", "copies", "offset", "hits", "error")


# Sound from vectors: a way to hear a table that holds no media. Each component is a note.
NOTE = 1024  # samples of a note


@lru_cache(maxsize=1)
def _scale() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    f = 220.0 * 2 ** (np.arange(24) / 12)
    return (0.5 * np.sin(2 * np.pi * f[:, None] * t) + 0.2 * np.sin(4 * np.pi * f[:, None] * t)).astype(np.float32)


def melody(values: list[float] | None) -> np.ndarray | None:
    """The samples of a vector's components, higher for larger ones; None for null or non-finite ones."""
    if values is None or any(v is None or not np.isfinite(v) for v in values):
        return None
    return _scale()[np.clip(np.round(np.array(values) * 60 + 12), 0, 23).astype(int)].ravel()


def as_recordings(batch: pa.RecordBatch):
    for v in batch["embedding"].to_pylist():
        yield melody(v)


def as_excerpts(batch: pa.RecordBatch):
    """The recording from its seventh note to its fourth from the end, softer, with a faint hum."""
    for v in batch["embedding"].to_pylist():
        x = melody(v)
        yield None if x is None else 0.6 * x[6 * NOTE : -4 * NOTE] + 0.01 * np.sin(np.arange(max(0, len(x) - 10 * NOTE)) * 0.7)


def find_excerpts(vectors: DataFrame, asks: Column) -> DataFrame:
    """align() of the excerpts of the rows that satisfy `asks` with the recordings of all rows."""
    rows = vectors.select(F.col("vec_id").alias("rec_id"), "embedding")
    known = saved(fingerprints(rows, as_recordings))
    return align(fingerprints(vectors.where(asks).select(F.col("vec_id").alias("rec_id"), "embedding"), as_excerpts), known)
