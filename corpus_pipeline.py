"""A training-data pipeline over the table documents: each stage applies one operator to all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgewell.llm import bpe, mixing, quality, simhash, substrings
from bridgewell.llm.interpolation import written
from bridgewell.llm.memory import small_batches
from bridgewell.llm.queries import table, vocabulary_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learns(5, 0))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: first of those whose SimHash fingerprints are linked (the operator of
    op4_simhash), then, of what is left, of those with a Jaccard similarity of 0.8 or more of their sets of five-word shingles, which fingerprints miss."""
    small_batches(spark)
    return simhash.keep_first(written(simhash.first_of_linked(docs)))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words and more that an earlier document holds."""
    small_batches(spark)
    return substrings.kept(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights; one that is chosen twice stands twice."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary) and the SHA-256 of the bytes that the ids decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good), ("near_duplicates", one_of_each), ("repeated_passages", without_repeats), ("mixing", to_weights), ("encoding", encoded)]

#: Fingerprints, learned scores and token ids have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again; the last one's are returned."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
