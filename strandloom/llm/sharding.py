"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. A group of at least a fixed share of all bytes is scheduled by itself;
there can be no more than shards * GRAIN of those. Smaller groups are hashed into shards * BUNDLES bundles.
Groups and bundles, largest first, go to the least-loaded shard through a heap. Both lists have a bound that
does not depend on the input, so the heap runs on the driver and its result is broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import table

SHARDS = 40
GRAIN = 500
BUNDLES = 250
OVERHEAD = 16
#: Rows of a shard's part that are numbered by one task.
PART_ROWS = 200_000
_PLAN = T.StructType([T.StructField("item", T.LongType()), T.StructField("shard", T.IntegerType())])


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item -> shard for (size, item); larger first, ties by item, to the least-loaded shard (ties: lowest)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def lpt_plan(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(large, bundles): shard of each large group by its key, and of each bundle by its number.

    rows: group (long), size (long).
    """
    spark = rows.sparkSession
    groups = table(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "lpt-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * GRAIN)))
    large = [(r["bytes"], r["group"]) for r in groups.where(F.col("bytes") >= least).collect()]
    bundles = groups.where(F.col("bytes") < least).groupBy(_bundle(shards)).agg(F.sum("bytes").alias("bytes")).collect()
    # one schedule for both: bundle b stands as ("b", b) among the groups
    items = [(size, ("g", g)) for size, g in large] + [(r["bytes"], ("b", r["bundle"])) for r in bundles]
    placed = lpt(items, shards)
    frames = [spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0] == kind], _PLAN) for kind in "gb"]
    return frames[0], frames[1]


def _bundle(shards: int):
    return F.pmod(F.xxhash64("group", F.lit(17)), F.lit(shards * BUNDLES)).cast("long").alias("bundle")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shard sizes near equal, as far as groups of equal texts allow (a group larger than a
    shard's share is a shard's own). size: UTF-8 bytes (null text: none) plus 16. Null texts are one group.
    Slots count from 0 in each shard without gaps; repeated rows have slots of their own. Null ids are
    numbered like others. An empty table gives no rows. Other columns are ignored.
    """
    data = F.encode("text", "utf-8")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    )
    rows = table(rows, "lpt-rows")
    large, bundles = lpt_plan(rows, shards)
    placed = (
        rows.withColumn("bundle", _bundle(shards))
        .join(F.broadcast(large.select(F.col("item").alias("group"), F.col("shard").alias("own"))), "group", "left")
        .join(F.broadcast(bundles.select(F.col("item").alias("bundle"), F.col("shard").alias("shared"))), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
    )
    parts = max(64, -(-rows.count() // (PART_ROWS * shards)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "group")
    return (
        placed.withColumn("nth", F.row_number().over(inner) - 1)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
