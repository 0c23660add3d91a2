"""Token ids in binary files, with one zstandard dictionary for all documents and access to single ones.

A folder holds shards, the dictionary and a manifest. A shard is, in little-endian numbers:

    header   MAGIC, SHA-256 of the dictionary (32 bytes, zeros without one), bytes per id (1), zeros (7)
    frames   one zstandard frame for each document: its ids, 2 or 4 bytes each
    index    for each document doc_id (8 bytes), for each whether doc_id is present (1), for each and the end the frame's offset (8), for each its
             number of ids (8)
    footer   offset of the index (8), documents (8), MAGIC

Documents lie in ascending doc_id order within a shard and over the shards. The manifest lists the shards with the documents and ids before each, so
that a document's place among all ids needs no other shard. Documents are compressed where they are encoded, so what is shuffled and sorted are frames.

Texts are cut at white space and the distinct runs encoded once. A tokenizer that drops white space, lower-cases and splits as _plain() expects is asked for the
pieces of runs of ASCII and Latin-1 letters alone; other runs go through its whole pipeline, and so do whole texts with any other tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import memory  # noqa: F401
from .components import checkpoint_folder
from .interpolation import written

MAGIC, LEVEL = b"TOKIDS01", 3
HEADER, FOOTER = struct.Struct("<8s32sB7x"), struct.Struct("<QQ8s")
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_IDS = 64 << 10, 2000, 2048  # the dictionary is trained on so many arrays, cut to so many ids
MOST_KEPT, LONG_RUN, BATCH_BYTES = 300_000, 64, 4 << 20
FORMAT = "bridgewell_tokens"

#: The split rule of word tokenizers that drop white space: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zà-öø-ÿß"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")  # of a lower-cased run
OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
ODD_SPACE, RUNS = re.compile("[\x1c-\x1f\x85\xa0  -     　]"), re.compile("[^ \t\n\r\f\v]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


BYTE_CHARACTER = _byte_characters()


def _plain(config: dict) -> bool:
    """Whether the tokenizer drops white space, lower-cases and splits by SPLIT before byte-level BPE."""
    steps = lambda key, name: ((config.get(key) or {}).get(name) or [])
    normal, cut = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    return (
        [s["type"] for s in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": "\\s+"} and normal[1]["content"] == " "
        and [s["type"] for s in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": SPLIT} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and not cut[1]["add_prefix_space"] and not cut[1].get("use_regex", True) and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and not config.get("truncation") and not config.get("padding"))


class _Kept(dict):
    """Values made when they are first asked for; those of long keys are not kept."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONG_RUN:
            self[key] = value
        return value


class Encoder:
    """Packed ids of texts by a tokenizer's JSON."""

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        config = json.loads(data)
        added = config.get("added_tokens") or []
        self.tokenizer = Tokenizer.from_str(data)
        self.model, self.marks = self.tokenizer.model, [t["content"] for t in added]
        self.plain = _plain(config) and not any(m.isalpha() for m in self.marks)
        self.width = 2 if max([*(t["id"] for t in added), self.tokenizer.get_vocab_size() - 1]) < 1 << 16 else 4
        self.kind = {2: "H", 4: "I"}[self.width]
        self.runs, self.pieces = _Kept(self._run), _Kept(self._piece)

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isprintable() else "".join(map(BYTE_CHARACTER.__getitem__, piece.encode()))
        return self.packed([t.id for t in self.model.tokenize(spelt)])

    def _run(self, run: str) -> bytes:
        if not run.isascii() and OTHER.search(run):
            return self.packed(self.tokenizer.encode(run, add_special_tokens=False).ids)
        if run.isalpha():
            return self.pieces[run.lower()]
        if any([m in run for m in self.marks]):
            return self.packed(self.tokenizer.encode(run, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(run.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        for kept in (self.runs, self.pieces):
            if len(kept) > MOST_KEPT:
                kept.clear()
        return b"".join(map(self.runs.__getitem__, RUNS.findall(text) if ODD_SPACE.search(text) else text.split()))


_MADE: dict[str, Encoder] = {}


def encoder(digest: str, data: str) -> Encoder:
    """One for each worker process and tokenizer."""
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = Encoder(data)
    return _MADE[digest]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays. Too few or too short arrays to train on stand for themselves; none give no dictionary."""
    try:
        return zstandard.train_dictionary(size, arrays, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def file_system(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))


def _put(uri: str, data: bytes) -> None:
    system, path = file_system(uri)
    with system.open_output_stream(path) as f:
        f.write(data)


def _get(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read()


@dataclass
class Shard(WriterCommitMessage):
    part: int
    name: str
    documents: int
    ids: int
    bytes: int
    least: int | None
    largest: int | None


class ShardWriter(DataSourceArrowWriter):
    """Writes the rows (doc_id, n_ids, frame) of a partition as one shard, in their order. A file that a lost or repeated task has left is
    not in the manifest, which is written when all tasks have ended."""

    def __init__(self, options: dict):
        self.folder, self.digest, self.width, self.end_id = options["path"], options["dictionary"], int(options["width"]), int(options["end_id"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4()}.tokens"
        ids, have, sizes, counts = ([] for _ in range(4))
        system, path = file_system(f"{self.folder}/{name}")
        file = None
        for b in iterator:
            if not len(b):
                continue
            if file is None:
                file = system.open_output_stream(path)
                file.write(HEADER.pack(MAGIC, bytes.fromhex(self.digest), self.width))
            column, frames = b.column(0), b.column(2)
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            have.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            counts.append(b.column(1).to_numpy(zero_copy_only=False).astype("<u8"))
            frames = frames.to_pylist()
            sizes.append(np.array([len(x) for x in frames], np.int64))
            file.write(b"".join(frames))
        if file is None:
            return Shard(part, "", 0, 0, 0, None, None)
        ids, have, sizes, counts = (np.concatenate(x) for x in (ids, have, sizes, counts))
        offsets = HEADER.size + np.concatenate([[0], np.cumsum(sizes)])
        index = ids.tobytes() + have.tobytes() + offsets.astype("<u8").tobytes() + counts.tobytes()
        file.write(index + FOOTER.pack(int(offsets[-1]), len(ids), MAGIC))
        file.close()
        known = ids[have == 1]
        return Shard(part, name, len(ids), int(counts.sum()), int(offsets[-1]) + len(index) + FOOTER.size, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None)

    def commit(self, messages: list) -> None:
        shards = sorted((asdict(m) for m in messages if m and m.documents), key=lambda s: s["part"])
        start = first = 0
        for s in shards:
            s["start"], s["first"] = start, first
            start, first = start + s["ids"], first + s["documents"]
        _put(f"{self.folder}/manifest.json", json.dumps({"dictionary": self.digest, "width": self.width, "end_id": self.end_id, "documents": first, "ids": start, "shards": shards}).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                system, path = file_system(f"{self.folder}/{m.name}")
                system.delete_file(path)


class OpenShard:
    """A shard's index, and the ids of its documents."""

    def __init__(self, folder: str, name: str, digest: str, dictionary: bytes):
        system, path = file_system(f"{folder}/{name}")
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        head, own, self.width = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or head != MAGIC or own.hex() != digest or (len(dictionary) and hashlib.sha256(dictionary).hexdigest() != digest):
            raise ValueError(f"{name} is no shard of this dictionary")
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.ids, self.have = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n) == 1
        self.offsets, self.counts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64), np.frombuffer(index, "<u8", n, 17 * n + 8).astype(np.int64)
        self.before = np.cumsum(self.counts) - self.counts
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def tokens(self, lo: int, hi: int) -> list[bytes]:
        """Ids of the documents lo to hi - 1, as little-endian unsigned 32-bit integers, in one read."""
        if lo == hi:
            return []
        data, at = self.file.read_at(int(self.offsets[hi] - self.offsets[lo]), int(self.offsets[lo])), self.offsets[lo : hi + 1] - self.offsets[lo]
        return [np.frombuffer(self.decompress(data[i:j]), f"<u{self.width}").astype("<u4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def rows(self, start: int) -> Iterator[pa.RecordBatch]:
        """All documents, about BATCH_BYTES of ids at a time."""
        cut = np.flatnonzero(np.diff(np.cumsum(4 * self.counts) // BATCH_BYTES)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(self.ids)], strict=True):
            yield self.batch(np.arange(lo, hi), self.tokens(lo, hi), start)

    def batch(self, at: np.ndarray, ids: list[bytes], start: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[at], pa.int64(), mask=~self.have[at]), pa.array(start + self.before[at]), pa.array(self.counts[at]), pa.array(ids, pa.binary())], NAMES)


NAMES = ["doc_id", "start", "n_tokens", "ids"]
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class ShardPartition(InputPartition):
    name: str
    start: int


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[ShardPartition]:
        return [ShardPartition(s["name"], s["start"]) for s in manifest(self.folder)["shards"]] or [ShardPartition("", 0)]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        if partition.name:
            digest = manifest(self.folder)["dictionary"]
            yield from OpenShard(self.folder, partition.name, digest, dictionary(self.folder, digest)).rows(partition.start)


class TokenFiles(DataSource):
    """The format FORMAT: writes rows (doc_id, n_ids, frame) as shards; reads documents with their place among all ids (SCHEMA)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options)


def manifest(folder: str) -> dict:
    return json.loads(_get(f"{folder}/manifest.json"))


def dictionary(folder: str, digest: str) -> bytes:
    return _get(f"{folder}/{digest}.dictionary") if int(digest, 16) else b""


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4()}"


def save(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encode the texts of docs by the tokenizer file at path (no special tokens added), append end_id to each, and write them to a new folder, whose
    name is returned. The folder is a URI or path that driver and executors reach alike; none: one in the shared checkpoint folder.

    doc_id is an integer; rows without one come first; rows of one id lie side by side, in a fixed order. A null or empty text has the end id alone; a very long
    one is one frame. No rows give a manifest without shards. Other columns are left out. Dictionary training takes a bounded sample (SAMPLE_ROWS rows,
    SAMPLE_IDS ids of each); it changes sizes alone.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    with open(path, encoding="utf-8") as f:
        data = f.read()
    digest = hashlib.sha256(data.encode()).hexdigest()
    sent = spark.sparkContext.broadcast(data)  # the tokenizer's file
    width = Encoder(data).width
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def arrays(batches):
        code = encoder(digest, sent.value)
        for b in batches:
            ids = [(code.encode(t) + code.packed([end_id]))[: SAMPLE_IDS * code.width] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    total, mark = slim.count(), F.xxhash64("doc_id", "text")
    some = slim.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(min(1 << 30, (2 * SAMPLE_ROWS << 30) // max(1, total))))
    sample = some.orderBy(mark).limit(SAMPLE_ROWS).mapInArrow(arrays, "ids binary").toArrow()["ids"].to_pylist()
    shared = train_dictionary(sorted(sample))
    shared = shared if _dictionary(shared) else b""
    named = hashlib.sha256(shared).hexdigest() if shared else "0" * 64
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    if shared:
        _put(f"{folder}/{named}.dictionary", shared)
    shared_sent = spark.sparkContext.broadcast(shared)  # DICTIONARY_BYTES at most

    def compressed(batches):
        code, own = encoder(digest, sent.value), _dictionary(shared_sent.value)
        if own:
            own.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own).compress
        end = code.packed([end_id])
        try:
            for b in batches:
                frames, counts = [], []
                for t in b["text"].to_pylist():
                    ids = code.encode(t) + end
                    counts.append(len(ids) // code.width)
                    frames.append(press(ids))
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_ids": pa.array(counts, pa.int64()), "frame": pa.array(frames, pa.binary())})
        finally:  # the worker lives on for other stages; pieces are few and kept
            code.runs.clear()

    frames = written(slim.mapInArrow(compressed, "doc_id long, n_ids long, frame binary"))
    order = ["doc_id", "n_ids", F.xxhash64("frame")]
    spark.dataSource.register(TokenFiles)
    frames.repartitionByRange(*order).sortWithinPartitions(*order).write.format(FORMAT).mode("append").option("dictionary", named).option("width", str(width)).option("end_id", str(end_id)).save(folder)
    return folder


def load(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens (long) and ids (binary, little-endian unsigned 32-bit integers) of every document."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(folder)


def lookup(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """As load(), for the documents named by doc_id in ids: of each shard that may hold them the index and those documents' frames are read. Unknown and
    null ids give no rows; an id that is asked for twice is answered once."""
    known = manifest(folder)
    shards = [s for s in known["shards"] if s["least"] is not None]
    digest, names, starts = known["dictionary"], [s["name"] for s in shards], [s["start"] for s in shards]
    least, largest = (np.array([s[k] for s in shards], np.int64) for k in ("least", "largest"))

    def place(batches):
        for b in batches:
            x = b["doc_id"].to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(largest, x, "left"), np.searchsorted(least, x, "right")
            n = np.maximum(hi - lo, 0)
            shard = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "doc_id": pa.array(np.repeat(x, n), pa.int64())})

    def fetch(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        shard = OpenShard(folder, names[k], digest, dictionary(folder, digest))
        asked = np.unique(group["doc_id"].to_numpy())
        at = np.flatnonzero(shard.have & np.isin(shard.ids, asked))
        return pa.Table.from_batches([shard.batch(at, [x for i in at.tolist() for x in shard.tokens(i, i + 1)], starts[k])])

    asked = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return asked.mapInArrow(place, "shard long, doc_id long").groupBy("shard").applyInArrow(fetch, SCHEMA)
