"""Counts of hashed k-mers by sample, and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts stop here.
SATURATION = 65535


def saturated(counts: DataFrame, limit: int = SATURATION) -> DataFrame:
    """(sample, bin, cnt) with counts cut at the limit; exact also for partial counts, as terms are never negative."""
    return counts.groupBy("sample", "bin").agg(F.least(F.sum("cnt"), F.lit(limit)).cast("long").alias("cnt"))


def saturated_by_bin(partial: DataFrame, partitions: int, limit: int = SATURATION) -> DataFrame:
    """``saturated`` of partial counts, dealt by bin alone: what is summed by bin later lies together already."""
    return saturated(partial.repartition(partitions, "bin"), limit)


def counts_of_reads(hashed: DataFrame, limit: int = SATURATION) -> DataFrame:
    """Counts from reads with bins."""
    return saturated(hashed.select("sample", F.explode("bins").alias("bin"), F.lit(1).alias("cnt")), limit)


def sample_summary(counts: DataFrame) -> DataFrame:
    """Bins and k-mers of each sample."""
    return counts.groupBy("sample").agg(F.count("*").alias("n_bins"), F.sum("cnt").alias("n_kmers"))


def idf(samples: Column, df: Column) -> Column:
    """log2((N + 2) / (df + 1)) of a bin that df of N samples have."""
    return F.log2((samples + 2) / (df + 1))


def idf_weights(counts: DataFrame) -> DataFrame:
    """(bin, df, gw): each bin's number of samples and ``idf``."""
    n = counts.select("sample").distinct().agg(F.count("*").alias("n"))
    seen = counts.groupBy("bin").agg(F.count("*").alias("df"))
    return seen.crossJoin(F.broadcast(n)).select("bin", "df", idf(F.col("n"), F.col("df")).alias("gw"))


def entropy_weights(counts: DataFrame) -> DataFrame:
    """(bin, gw): 1 + sum(p ln p) / ln N over a bin's samples, p = count / the bin's total."""
    n = counts.select("sample").distinct().agg(F.count("*").alias("n"))
    # sum(p ln p) = sum(c ln c) / T - ln T: one pass of partial sums, no second look at the rows
    c = F.col("cnt").cast("double")
    sums = counts.groupBy("bin").agg(F.sum(c * F.log(c)).alias("s"), F.sum("cnt").cast("double").alias("t"))
    return sums.crossJoin(F.broadcast(n)).select("bin", (1 + (F.col("s") / F.col("t") - F.log("t")) / F.log("n")).alias("gw"))


def nonzero_bins(counts: DataFrame) -> DataFrame:
    """Bins that any sample has."""
    return counts.groupBy("bin").agg(F.sum("cnt").alias("total")).where("total > 0").select("bin")


def masked(counts: DataFrame, mask: DataFrame) -> DataFrame:
    """Counts without the bins of a mask."""
    return counts.join(mask, "bin", "left_anti")


def conditioned(counts: DataFrame, weights: DataFrame, hash_size: int) -> DataFrame:
    """(sample, bin, x): count times weight over the sample's root mean square of counts, over all 2**hash_size bins.

    A sample without counts has no rows, and so no norm of zero.
    """
    c = F.col("cnt").cast("double")
    norms = counts.groupBy("sample").agg(F.sqrt(F.sum(c * c) / float(1 << hash_size)).alias("norm"))
    rows = counts.join(weights.select("bin", "gw"), "bin").join(norms, "sample")
    return rows.select("sample", "bin", (F.col("cnt") * F.col("gw") / F.col("norm")).alias("x"))


def log_conditioned(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample, bin, x): log(count + 1) times weight."""
    return counts.join(weights.select("bin", "gw"), "bin").select("sample", "bin", (F.log1p("cnt") * F.col("gw")).alias("x"))
