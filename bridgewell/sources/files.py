"""Reading and writing files: JSON Lines, CSV, Parquet; what files hold, by their first bytes and by schema."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.quality import estimated_bytes
from .heads import file_heads, reachable

HEAD = 2048


def read_json(spark: SparkSession, paths: str | Sequence[str], schema=None, drop_malformed: bool = False, sampling: float | None = None) -> DataFrame:
    """JSON Lines; folders, globs and .gz files too. Without a schema it is inferred, from a share of the rows if given."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if sampling is not None:
        r = r.option("samplingRatio", sampling)
    if drop_malformed:
        r = r.option("mode", "DROPMALFORMED")
    return r.json(list(paths) if not isinstance(paths, str) else paths)


def malformed_count(spark: SparkSession, paths, schema: str) -> int:
    """Rows that do not parse under the schema (DDL)."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(paths)
    fields = F.struct(*[c for c in rows.columns if c != "_corrupt_record"])  # the reader wants a field besides
    return rows.select("_corrupt_record", F.to_json(fields).alias("f")).where("_corrupt_record is not null and f is not null").count()


def read_csv(spark: SparkSession, paths, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(paths)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, files: int | None = None, shuffle: bool = False) -> None:
    """Overwrite. files: at most so many by coalesce, or exactly with a shuffle."""
    if files:
        df = df.repartition(files) if shuffle else df.coalesce(files)
    df.write.mode("overwrite").parquet(path)


def write_and_count(df: DataFrame, path: str, files: int | None = None) -> int:
    """Write once, then count from the footers."""
    write_parquet(df, path, files)
    return df.sparkSession.read.parquet(path).count()


def write_and_report(df: DataFrame, path: str, files: int | None = None) -> dict[str, int]:
    """Write once and tell, without another job: rows (observed while they are written), estimated_bytes (the optimizer's) and bytes (of the rows as JSON
    text, observed too)."""
    seen, estimate = Observation(), estimated_bytes(df)
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes")), path, files)
    return {"estimated_bytes": estimate, **seen.get}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def kind_of_head(head: Column) -> Column:
    """What a JSON Lines file holds, by the field names in its first bytes."""
    has = lambda *names: F.greatest(*[F.contains(head, F.lit(f'"{n}"')) for n in names]) if len(names) > 1 else F.contains(head, F.lit(f'"{names[0]}"'))
    review = has("rating") & (~has("average_rating") | has("user_id", "fullName"))
    return (
        F.when(review & has("fullName", "productId"), "vn_review").when(review, "amz_review")
        .when(has("specifications", "product_url"), "vn_item").when(has("features", "main_category", "parent_asin"), "amz_item").otherwise("unknown"))


def classify(spark: SparkSession, path: str, head: int = HEAD) -> DataFrame:
    """path and kind of each file, by its first `head` characters; an empty file is 'unknown'. Heads are read by ranges (heads.py); in stores that only Spark reaches, files are read
    as lines, of each the first ones alone."""
    files = spark.read.text(path)
    listed = files.inputFiles()
    if all(map(reachable, listed)):
        found = file_heads(spark, listed, head)
        return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), kind_of_head(F.col("head")).alias("kind"))
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.substring("value", 1, head).alias("line")).where("_at = 0")
    first = Window.partitionBy("path").orderBy("_n")
    few = lines.withColumn("_n", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= head)  # a line has one character at least, its end
    heads = few.groupBy("path").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"]), "\n"), 1, head).alias("head"))
    every = spark.createDataFrame([(p,) for p in listed], "path string")  # the listing that Spark has made; a scan passes over empty files
    plain = lambda d: d.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    return plain(every).join(plain(heads), "path", "left").select("path", kind_of_head(F.coalesce("head", F.lit(""))).alias("kind"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """kind, paths (sorted), n_files."""
    return classify(spark, path).groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("n_files"))


def profile(spark: SparkSession, datasets: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """name, n_columns, columns, n_rows, is_meta, error of each data set; a broken one gives its error."""
    rows = []
    for name, path in datasets.items():  # a handful of paths, not data
        try:
            df = spark.read.format(fmt).load(path)
            rows.append((name, len(df.columns), ",".join(f"{c}:{t}" for c, t in df.dtypes), df.count(), "meta_" in path, None))
        except Exception as e:  # noqa: BLE001  kept per data set
            rows.append((name, None, None, None, "meta_" in path, str(e)[:200]))
    return spark.createDataFrame(rows, "name string, n_columns int, columns string, n_rows long, is_meta boolean, error string")


@contextmanager
def kept(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Persisted inside the block."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
