"""Running sums and consecutive numbers in a total order, without a window over all rows or over a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def running(df: DataFrame, group: list[str], order: list[Column], value: Column | int, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to and including this one in ``order``.

    Rows are range-partitioned by group and order; windows run inside each range, and what lies before a range comes from the
    sums of (range, group), so a group with most of the rows is shared by many tasks. The ranges are written at once, as they
    must be the same for both uses.
    """
    value = F.lit(value) if isinstance(value, int) else value
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("_v", value).repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_p", F.spark_partition_id())
    own = scratch.written(own, "ranges")
    sums = own.groupBy("_p", *group).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_b", F.sum("_s").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_s")).drop("_s")
    inside = own.withColumn("_r", F.sum("_v").over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = [inside["_p"] == before["_p"], *[inside[g].eqNullSafe(before[g]) for g in group]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return inside.join(before, cond).select(*[inside[c] for c in df.columns], (inside["_r"] + before["_b"]).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1, group: list[str] | None = None) -> DataFrame:
    """Adds consecutive numbers in a total order, of all rows or within groups.

    Without groups, ranges are sorted before they are written, so a row's number is its place in its range and the sizes of the ranges
    before: one shuffle, and no window over the rows.
    """
    if group:
        out = running(df, group, order, 1, name)
        return out.withColumn(name, (F.col(name) + (start - 1)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())  # the range and, in 33 bits, the place in it
    own = scratch.written(own, "ranges").withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = own.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_earlier"))  # a row for each range
    return own.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_place") + F.col("_earlier") + start).cast("long").alias(name))
