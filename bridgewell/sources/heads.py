"""The first characters of files by range reads: no more of a file is read than they take."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Stores whose files can be read by ranges from Python; others are left to Spark's own readers.
SCHEMES = {"file", "s3", "s3a", "s3n", "gs", "hdfs", "abfs", "abfss"}
FILES = 64  # files of a task, about


def reachable(path: str) -> bool:
    scheme = re.match(r"([a-zA-Z0-9]+):", path)
    return scheme is None or scheme[1].lower() in SCHEMES


def read_head(uri: str, characters: int) -> tuple[str, int]:
    """The first characters of a file (UTF-8, gzip or not; what is not UTF-8 is replaced), and how many bytes were read for them."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!//)", "file:///", uri)))
    most = 4 * characters  # bytes of so many characters
    with system.open_input_file(path) as f:
        raw = f.read(most)
        read, out = len(raw), raw
        if raw[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(47)
            out = unpack.decompress(raw, most)
            while len(out) < most and not unpack.eof and (raw := f.read(characters)):
                read += len(raw)
                out += unpack.decompress(raw, most - len(out))
    return out.decode("utf-8", "replace")[:characters], read


def file_heads(spark: SparkSession, paths: list[str], characters: int) -> DataFrame:
    """path, head, read (bytes) of each file; an empty one has an empty head."""

    def run(batches):
        for b in batches:
            found = [read_head(p, characters) for p in b["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["path"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["path", "head", "read"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // FILES)))
    return listed.mapInArrow(run, "path string, head string, read long")
