"""Memory of Python workers and disk of ended steps: freed Arrow buffers go back to the system, batches of whole texts stay small, and shuffle files go when nothing needs them."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

pa.set_memory_pool(pa.system_memory_pool())


def small_batches(spark: SparkSession) -> None:
    """Rows are whole documents here: batches of Spark's default 10,000 rows take tens of MB, several times over. A session that has
    set another size keeps it."""
    if spark.conf.get(SETTING, "10000") == "10000":
        spark.conf.set(SETTING, str(BATCH_ROWS))


def trim() -> None:
    """Give what a task has freed back to the system: workers live on for tasks of other stages, and what one leaves adds to what the next one takes."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if free:
        free(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone. It does so when the driver's JVM collects them, which a mostly idle driver may not do for half an hour,
    while an operator of many steps fills the executors' disks."""
    spark.sparkContext._jvm.System.gc()
