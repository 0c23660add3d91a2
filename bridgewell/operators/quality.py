"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import MOST, exact_quantiles


def _blank(c: str) -> Column:
    return F.sum(F.when(F.col(c).isNull() | (F.col(c) == ""), 1).otherwise(0))


def interaction_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("product_id").alias("n_items"),
        _blank("user_id").alias("blank_users"), _blank("product_id").alias("blank_items"),
        F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"), F.round(F.avg("rating"), 6).alias("avg_rating"))


def item_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("product_id").alias("n_items"), _blank("full_text").alias("blank_texts"),
        F.round(F.avg(F.length("full_text")), 6).alias("avg_length"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 1; 0 below, bins + 1 above) and n."""
    return df.where(value.isNotNull()).groupBy(F.width_bucket(value.cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def distribution_by(df: DataFrame, by: str, value: str, most: int = MOST) -> DataFrame:
    """What a box plot shows: least, quartiles, largest. Where a group has more than `most` values, quartiles are found by selection (quantiles.py), so that no task holds the
    values of a group."""
    extent = [F.min(value).alias("least"), F.max(value).alias("largest"), F.count(value).alias("n")]
    if (df.groupBy(by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
        return df.groupBy(by).agg(extent[0], q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), *extent[1:])
    found = exact_quantiles(df, by, value, (0.25, 0.5, 0.75), most=most).withColumnRenamed(by, "_g")
    whole = df.groupBy(by).agg(*extent).join(found, F.col(by).eqNullSafe(F.col("_g")), "left")
    q = lambda i: F.round(F.col("q")[i], 6)
    return whole.select(by, "least", q(0).alias("q1"), q(1).alias("median"), q(2).alias("q3"), "largest", "n")


def join_sorted_set(df: DataFrame, key: str, value: str, sep: str = " | ") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias(value))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
