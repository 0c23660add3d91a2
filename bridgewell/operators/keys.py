"""Keys: choosing rows by key, key joins, and reports on keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all neither null nor empty."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys]))


def map_fields(df: DataFrame, spec: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """A canonical schema: for each name, the first source column that exists, cast to the type, or a null of it."""
    have = set(df.columns)
    return df.select(*[F.col(found).cast(kind).alias(name) if (found := next((s for s in sources if s in have), None)) else F.lit(None).cast(kind).alias(name) for name, (sources, kind) in spec.items()])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, keys: Sequence[str], ts: str, *tie: Column) -> DataFrame:
    """The newest row of each key; ties by the given order."""
    return one_per_key(df, keys, [F.col(ts).desc_nulls_last(), *tie])


def union_all(frames: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def positives(queries: DataFrame, items: DataFrame, query_key: str, item_key: str) -> DataFrame:
    """Pairs with an equal key, label 1; empty keys pair with nothing."""
    return with_keys(queries, query_key).join(with_keys(items, item_key), F.col(query_key) == F.col(item_key)).withColumn("label", F.lit(1))


MEET = 4096  # rows of one key and side that meet those of the other in one place
TILE = 256  # rows of the other side that follow one another beside each row: files then hold short cycles of values, which compress whatever the size of a key
RUN = 16  # rows that are unfolded beside a tile at once: Spark holds all rows that one row unfolds into


def same_key_pairs(a: DataFrame, b: DataFrame, on: str, key: str) -> DataFrame:
    """Every row of a beside every row of b with the same `on`. key: a column of a by whose hash it is dealt; rows of b are dealt by the hash of all their columns. Both sides of a key are
    folded into blocks, each block of a meets each one of b in a place of its own, and pairs are unfolded there, tile by tile, without being kept. Their number grows with the product of both
    sides of a key, what is shuffled with that of the blocks."""
    blocks = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / MEET).cast("int").alias(name))
    place = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    mine, theirs = [c for c in a.columns if c != on], [c for c in b.columns if c != on]
    n = blocks(a, "_as").join(blocks(b, "_bs"), on)  # a row for each key
    folded = lambda df, at, cols, *by: df.join(n, on).groupBy(on, "_as", "_bs", place(at, *by).alias(at[:2])).agg(F.collect_list(F.struct(*cols)).alias(at[:2] + "_rows"))
    every = lambda at: F.explode(F.sequence(F.lit(0), F.col(at) - 1))
    places = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not to be merged by their bytes
    dealt = lambda df: df.drop("_as", "_bs").repartition(places, on, "_a", "_b")
    met = dealt(folded(a, "_as", mine, key).withColumn("_b", every("_bs"))).join(dealt(folded(b, "_bs", theirs, *theirs).withColumn("_a", every("_as"))), [on, "_a", "_b"])
    cut = lambda rows, most: F.explode(F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(most)), lambda i: F.slice(rows, i, most)))
    runs = met.select(on, "_a_rows", cut("_b_rows", TILE).alias("_tile")).select(on, "_tile", cut("_a_rows", RUN).alias("_run"))
    pairs = runs.select(on, "_tile", F.explode("_run").alias("_x")).select(on, "_x", F.explode("_tile").alias("_y"))
    return pairs.select(on, *[F.col(f"_x.{c}") for c in mine], *[F.col(f"_y.{c}") for c in theirs])


def known(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def unknown(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def frontier(df: DataFrame, done: DataFrame, on: str, source: str) -> DataFrame:
    """Per source: rows, rows whose key is done, rows left."""
    marked = df.join(done.select(F.col(on), F.lit(1).alias("_done")).distinct(), on, "left")
    return marked.groupBy(source).agg(F.count("*").alias("n_rows"), F.count("_done").alias("n_removed"), (F.count("*") - F.count("_done")).alias("n_left"))


def override(df: DataFrame, new: DataFrame, on: str, column: str) -> DataFrame:
    """The column's value from `new` where it has the key."""
    return df.join(new.select(on, F.col(column).alias("_new")), on, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def shared_keys(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: how many distinct keys both hold."""
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_semi").agg(F.count("*").alias("n_shared"))


def dense_ids(df: DataFrame, key: str, name: str = "idx", buckets: int = 256) -> DataFrame:
    """Distinct keys numbered from 0 in the order of their hash bucket and text.

    Numbers are dealt by bucket, so that no task sorts all keys: bucket sizes are summed first.
    """
    keys = df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 2), 16, 10).cast("int") % buckets)
    sizes = keys.groupBy("_b").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 256 rows
    within = keys.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.col(key))))
    return within.join(F.broadcast(before), "_b").select(key, (F.col("_before") + F.col("_n") - 1).cast("long").alias(name))
