"""Exact quantiles by selection: the cells of a histogram that hold the wanted ranks are narrowed until few values are left in each, which alone are put in order.

A cell is known by its least and largest value, so that no value falls between two cells. No task holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

CELLS, MOST = 1024, 1 << 20  # cells of a histogram; values of a cell that are put in order


def exact_quantiles(df: DataFrame, by: str, value: str, probabilities: Sequence[float], cells: int = CELLS, most: int = MOST) -> DataFrame:
    """by and q (array of double, one for each probability, interpolated between neighbours). Null values take no part; a null group is a group; groups without values give no
    rows. Values are numbers without NaN. Each round reads the table once."""
    slim = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    found = saved(slim.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for i, p in enumerate(probabilities)])).alias("p")
    wanted = found.select("g", at, "lo", "hi", "n").select("g", "p.i", "p.h", F.explode(F.array_distinct(F.array(F.floor("p.h"), F.ceil("p.h")))).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m"))
    wanted = saved(wanted)
    same = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))

    def inside(ranks: DataFrame) -> DataFrame:
        """The values of the cells in which ranks lie, once for each cell."""
        spans = ranks.select("g", "lo", "hi", "below").distinct()
        return slim.alias("s").join(spans.alias("c"), same("s", "c") & (F.col("s.v") >= F.col("c.lo")) & (F.col("s.v") <= F.col("c.hi"))).select("c.g", "c.lo", "c.hi", "c.below", "s.v")

    while (wanted.where("lo < hi").agg(F.max("m")).first()[0] or 0) > most:
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
        counts = inside(wanted.where(f"lo < hi and m > {most}")).groupBy("g", "lo", "hi", "below", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "lo", "hi", "below").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("start", F.col("below") + before)
        on = same("w", "c") & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi")) & (F.col("w.k") >= F.col("c.start")) & (F.col("w.k") < F.col("c.start") + F.col("c.n"))
        full = F.col("lo").isNotNull() & (F.col("lo") < F.col("hi")) & (F.col("m") > most)
        narrow = wanted.where(full).alias("w").join(counts.alias("c"), on).select("w.g", "w.i", "w.h", "w.k", F.col("c.new_lo").alias("lo"), F.col("c.new_hi").alias("hi"), F.col("c.start").alias("below"), F.col("c.n").alias("m"))
        wanted = saved(narrow.unionByName(wanted.where(~full)))
    order = Window.partitionBy("g", "lo", "hi", "below").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = inside(wanted.where("lo < hi")).groupBy("g", "lo", "hi", "below", "v").agg(F.count("*").alias("n")).withColumn("end", F.col("below") + F.sum("n").over(order))
    on = same("w", "c") & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi")) & (F.col("w.k") >= F.col("c.end") - F.col("c.n")) & (F.col("w.k") < F.col("c.end"))
    chosen = wanted.where("lo < hi").alias("w").join(counted.alias("c"), on).select("w.g", "w.i", "w.h", "w.k", "c.v").unionByName(wanted.where("lo = hi").select("g", "i", "h", "k", F.col("lo").alias("v")))
    share = F.when(F.col("k") == F.floor("h"), 1 - (F.col("h") - F.floor("h"))).otherwise(F.col("h") - F.floor("h"))
    each = chosen.groupBy("g", "i").agg(F.sum(F.col("v") * share).alias("q"))
    return each.groupBy(F.col("g").alias(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))  # as many as probabilities
