"""Appending only new keys to a table, in batches or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import one_per_key


def new_rows(batch: DataFrame, table: DataFrame | None, key: str) -> DataFrame:
    """Rows of the batch whose key is not in the table, one for each key: the first in the order of all columns. Empty and null keys are dropped."""
    order = [F.col(c).asc_nulls_last() for c in batch.columns]
    fresh = one_per_key(batch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], order)
    return fresh if table is None else fresh.join(table.select(key), key, "left_anti").select(*batch.columns)


BUCKETS, BUCKET = 256, "_bucket"  # parts of a table, by the hash of its key, and the folder's name for them


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def touched(spark: SparkSession, batch: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The keys of the table that the batch's keys can meet: those in the batch's buckets. None without a table."""
    try:
        table = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    if BUCKET not in table.columns:  # written by others
        return table.select(key)
    own = [r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket_of(key, buckets)).distinct().collect()]  # at most `buckets`
    return table.where(F.col(BUCKET).isin(own)).select(key)


def append_batch(spark: SparkSession, batch: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Add the rows of new keys to a table of folders by bucket (a column _bucket when it is read), of which those are read that the batch touches. A batch that is given again adds
    nothing. One writer at a time; the number of buckets stays as it was first."""
    fresh = new_rows(batch, touched(spark, batch, path, key, buckets), key)
    try:
        parted = BUCKET in spark.read.parquet(path).columns
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        parted = True
    if parted:
        fresh.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    else:
        fresh.write.mode("append").parquet(path)


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str, ts: str | None = None, late: str = "1 hour"):
    """Start a query that appends new keys of the stream. With a time column, repeats within the watermark are dropped in state; the anti
    join against the touched buckets covers all others, and a batch that is tried again."""
    if ts:
        stream = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return stream.writeStream.foreachBatch(lambda df, _: append_batch(df.sparkSession, df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
