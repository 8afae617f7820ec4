"""Putting reads into shape before hashing: interleaved chunks, mapper output, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.kmer import mate_id, pair_key, read_base_id, trimmed_length
from ..sources.fastq import clean_bases, id_types, quality_offset

#: Reads of a chunk of pairs, and of single reads.
CHUNK_READS = 1_000_000


def interleave_chunks(first: DataFrame, second: DataFrame, chunk_reads: int = CHUNK_READS) -> DataFrame:
    """Mates 1 and 2 of a sample as one table: ``rec_no`` runs 2i, 2i + 1 over pairs, ``part`` is the chunk, three digits or more.

    Pairs are joined by sample and record number, so nothing is zipped by position across partitions; a mate
    without a partner keeps its place.
    """
    both = first.withColumn("mate", F.lit(0)).unionByName(second.withColumn("mate", F.lit(1)))
    number = F.col("rec_no") * 2 + F.col("mate")
    chunk = F.lpad(F.floor(number / chunk_reads).cast("string"), 3, "0")
    return both.withColumn("part", F.when(number >= chunk_reads * 1000, F.floor(number / chunk_reads).cast("string")).otherwise(chunk)).withColumn("rec_no", number).drop("mate")


def single_chunks(reads: DataFrame, chunk_reads: int = CHUNK_READS) -> DataFrame:
    """Single reads cut into chunks by record number."""
    return reads.withColumn("part", F.lpad(F.floor(F.col("rec_no") / chunk_reads).cast("string"), 3, "0"))


def byte_chunks(reads: DataFrame, megabytes: int = 500) -> DataFrame:
    """Reads cut by bytes of FASTQ text: ``part`` counts up whenever a sample's running total passes a multiple.

    The running total is taken over ranges of 100 000 records, then over the ranges' sums, so that no task
    sees a whole sample.
    """
    size = F.length("id") + F.length("seq") + F.length("plus") + F.length("qual") + 4
    rows = reads.withColumn("_size", size.cast("long")).withColumn("_range", F.floor(F.col("rec_no") / 100_000))
    sums = rows.groupBy("sample", "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("sample").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy("sample", "_range").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_before") + F.sum("_size").over(inner)
    part = F.floor((end - F.col("_size")) / (megabytes * 1_000_000))
    return rows.join(sums, ["sample", "_range"]).withColumn("part", F.lpad(part.cast("string"), 3, "0")).drop("_size", "_range", "_before")


def prepared(reads: DataFrame, k: int, q_offset: int | None = None, id_type: int | None = None) -> DataFrame:
    """Reads as they are hashed, with ``q_offset``, ``kept`` (bases before the quality falls) and ``pair_key``.

    An offset or a type of ids that isn't given is told from the first reads of each file (sample, part). The read
    itself stays as it is; reads with more than five symbols are left out. A read without qualities keeps all bases.
    """
    rows = reads.where(clean_bases(F.col("seq")).isNotNull())
    if q_offset is None:
        rows = rows.join(quality_offset(reads), ["sample", "part"], "left")
    else:
        rows = rows.withColumn("q_offset", F.lit(q_offset))
    if id_type is None:
        rows = rows.join(id_types(reads), ["sample", "part"], "left")
    else:
        rows = rows.withColumn("id_type", F.lit(id_type))
    base = lambda t: pair_key(read_base_id(F.col("id"), t))
    rows = rows.withColumn("q_offset", F.coalesce("q_offset", F.lit(33)))
    kept = F.coalesce(F.least(trimmed_length(F.col("qual"), k, F.col("q_offset")), F.length("seq")), F.length("seq"))
    key = F.when(F.col("id_type") == 1, base(1)).when(F.col("id_type") == 2, base(2)).otherwise(base(0))
    return rows.withColumn("kept", kept.cast("int")).withColumn("pair_key", key).drop("id_type")


def mapper_rows(hashed: DataFrame, base_id: Column) -> DataFrame:
    """(id, bin): each bin of a read under its own id and under its mate's."""
    return hashed.select(F.explode(F.array(base_id, mate_id(base_id))).alias("id"), "bins").select("id", F.explode("bins").alias("bin"))


def counted(rows: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counters that are filled while an action runs over them (reads hashed, written, unique)."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def hash_parts(hash_size: int, per_task: int = 1_000_000) -> int:
    """Ranges of bins that older schedulers gave to one task each; here a plain figure."""
    return (1 << hash_size) // per_task + 1
