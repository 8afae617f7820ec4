"""Numbers along a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Rows of a range, and how many ranges' offsets are broadcast at most.
RANGE_ROWS = 1_000_000
BROADCAST_RANGES = 100_000


def numbered(rows: DataFrame, order: list[Column], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Rows with dense numbers from 0 in a global order: sorted by range, numbered within, ranges' sizes added up.

    The result is a written table, ranges in order. Rows that are equal in the order have an arbitrary order that stays.
    """
    spark = rows.sparkSession
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), f"numbered-{name}")
    held = held.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    above = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_above"))
    if ranges <= BROADCAST_RANGES:
        above = F.broadcast(above)
    return held.join(above, "_range").withColumn(name, F.col("_above") + F.col("_in")).drop("_at", "_range", "_in", "_above")
