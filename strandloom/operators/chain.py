"""Greedy windows over intervals, as a chain of pointers that is followed without walking it row by row.

In order of lower bounds, a window lasts to the upper bound of its first interval, and the first interval that begins beyond
it starts the next. Which interval that would be is known for every interval without knowing the windows (its successor).
Only the chain from the first interval on counts: each part of the order is shortcut to where a chain that enters it leaves
it, the shortcuts are doubled until they reach the end, and the parts that the chain enters mark its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .numbering import numbered

#: Intervals of a part.
PART_ROWS = 4096


def successors(ordered: DataFrame) -> DataFrame:
    """(pos, next) of (pos, lo, hi) in order of lo: the first pos whose lo is over this hi; the number of rows where none is.

    Bounds are sorted together, and a bound's successor is how many lower bounds stand at or before it.
    """
    lows = ordered.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"))
    highs = ordered.select(F.col("hi").alias("at"), F.lit(1).alias("kind"), "pos")
    events = numbered(lows.unionByName(highs), [F.asc("at"), F.asc("kind"), F.asc("pos")], "nth")
    # upper bounds before one are as many as its place among the upper bounds
    among = numbered(highs.select("at", "pos"), [F.asc("at"), F.asc("pos")], "rank").select("pos", "rank")
    return events.where("kind = 1").select("pos", "nth").join(among, "pos").select("pos", (F.col("nth") - F.col("rank")).alias("next"))


def _parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """Rows (pos, next, ...) in order within parts, each in one partition."""
    parts = rows.withColumn("part", F.floor(F.col("pos") / part_rows).cast("long"))
    return parts.repartition("part").sortWithinPartitions("part", "pos")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole parts; column 0 is the part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)] if len(part) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != part[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def heads(links: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(pos, head): whether the chain from pos 0 over ``next`` (always larger) comes by; links is a written table (pos, next)."""

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_part(batches):
            pos, follows = t.column(1).to_numpy(), t.column(2).to_numpy().copy()
            for i in range(len(pos) - 1, -1, -1):  # from the back: what follows inside the part knows already where it leaves
                if follows[i] <= pos[-1]:
                    follows[i] = follows[follows[i] - pos[0]]
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(follows)], names=["pos", "next"])

    parts = _parts(links, part_rows).select("part", "pos", "next")
    jumps = stored(parts.mapInArrow(leaving, "pos long, next long"), "chain-jumps")
    entered = jumps.where("pos = 0").select("pos")
    steps = max(1, -(-links.count() // part_rows)).bit_length()
    tables = [jumps]
    for _ in range(steps - 1):
        last = tables[-1]
        further = last.select(F.col("pos").alias("next"), F.col("next").alias("beyond"))
        tables.append(stored(last.join(further, "next").select("pos", F.col("beyond").alias("next")), "chain-doubled"))
    # from far jumps to near ones: whatever place the chain has is reached by some of them
    for jump in reversed(tables):
        reached = jump.join(entered, "pos", "left_semi").select(F.col("next").alias("pos"))
        entered = stored(entered.unionByName(reached).distinct(), "chain-entered")
    marked = links.join(entered.withColumn("in", F.lit(True)), "pos", "left")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_part(batches):
            pos, follows, entry = (t.column(i).to_numpy() for i in (1, 2, 3))
            head = np.zeros(len(pos), dtype=bool)
            for i in np.flatnonzero(entry):
                at = int(pos[i])
                while at <= pos[-1] and not head[at - pos[0]]:
                    head[at - pos[0]] = True
                    at = int(follows[at - pos[0]])
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(head)], names=["pos", "head"])

    rows = _parts(marked.select("pos", "next", F.coalesce("in", F.lit(False)).alias("entry")), part_rows)
    return rows.select("part", "pos", "next", "entry").mapInArrow(walked, "pos long, head boolean")


def windows(intervals: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(lib, sample) from (sample, lo, hi): in order of lo, hi and sample, an interval whose lo is over the hi of its window's
    first one starts a new window, numbered from 0. lo is at most hi. Null bounds are left out; an empty table gives no rows."""
    usable = intervals.where(F.col("lo").isNotNull() & F.col("hi").isNotNull()).select("sample", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    ordered = stored(numbered(usable, [F.asc("lo"), F.asc("hi"), F.asc("sample")]), "intervals")
    links = stored(successors(ordered), "chain-links")
    found = stored(heads(links, part_rows).withColumn("part", F.floor(F.col("pos") / part_rows)), "chain-heads")
    # windows before a part, then within it
    sums = found.groupBy("part").agg(F.count_if("head").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("above"))
    inside = F.sum(F.col("head").cast("int")).over(Window.partitionBy("part").orderBy("pos"))
    lib = (F.col("above") + inside - 1).cast("int").alias("lib")
    return found.join(sums, "part").select("pos", lib).join(ordered, "pos").select("lib", "sample")
