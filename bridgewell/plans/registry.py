"""All registered queries outside the llm subpackage, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_ranking, queries_tables, queries_text
from .roles import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

assert queries_ranking and queries_tables and queries_text  # they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q2_item_nodes"](spark, sf_dir)
