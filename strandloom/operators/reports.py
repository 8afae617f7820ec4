"""Reports over partitions, alignments, profiles and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n50(lengths: DataFrame, group: str, length: str) -> DataFrame:
    """(group, n, total, longest, n50): n50 is the first length, longest first, at which the running total is over half (cut to an integer).

    Equal lengths are added up before the running total, so a group is as many rows as it has lengths.
    """
    by_length = lengths.groupBy(group, length).agg(F.count("*").alias("k"))
    along = Window.partitionBy(group).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("k") * F.col(length)
    run = by_length.withColumn("run", F.sum(mass).over(along)).withColumn("total", F.sum(mass).over(Window.partitionBy(group)))
    return run.groupBy(group).agg(
        F.sum("k").alias("n"), F.max("total").alias("total"), F.max(length).alias("longest"),
        F.max(F.when(F.col("run") > F.floor(F.col("total") / 2), F.col(length))).alias("n50"),
    )


def alignment_scores(rows: DataFrame) -> DataFrame:
    """(path, sseqid, score): sums of the first score of each (block, subject, query range)."""
    first = rows.groupBy("path", "block", "sseqid", "qseqid", "qstart", "qend").agg(F.min_by("score", "line_no").alias("score"))
    return first.groupBy("path", "sseqid").agg(F.sum("score").alias("score"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def share_of_group(rows: DataFrame, group: list[str], name: str, value: str) -> DataFrame:
    """(group, name, total, share): each name's sum and its part of the group's."""
    sums = rows.groupBy(*group, name).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*group)))


def pivot_counts(rows: DataFrame, group: str, across: str, names: list, value: Column | None = None) -> DataFrame:
    """One column for each name, in the given order; absent ones are 0."""
    counted = rows.groupBy(group).pivot(across, names).agg(F.count(F.lit(1)) if value is None else F.sum(value))
    return counted.na.fill(0)


def by_abundance(rows: DataFrame, across: str) -> list:
    """All names by descending total, for a pivot's columns."""
    return [r[0] for r in rows.groupBy(across).agg(F.count("*").alias("n")).orderBy(F.desc("n"), across).collect()]


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, lo, hi, mid): minimum, maximum and upper median (element n div 2 of the sorted values).

    Values are counted and ranked by running counts; no group is gathered into one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    along = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("run", F.sum("k").over(along)).withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    at = F.min(F.when(F.col("run") > F.floor(F.col("n") / 2), F.col(value)))
    return run.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), at.alias("mid"))


def left_report(base: DataFrame, *others: tuple[DataFrame, str, dict]) -> DataFrame:
    """Left joins of (table, key, defaults) to a base table."""
    out = base
    for other, key, defaults in others:
        out = out.join(other, key, "left").na.fill(defaults)
    return out


def unprocessed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key), key, "left_anti")
