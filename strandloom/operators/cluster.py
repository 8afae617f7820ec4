"""Clusters of vectors in the eigenspace: leaders, assignment, inversion, priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from . import metric
from .metric import matrix, unit
from .numbering import numbered

NEAREST = 5
#: Vectors that one task clusters, and of them so many at once.
PART_ROWS = 250_000
CHUNK_ROWS = 4096
#: Centroids go to all tasks up to so many bytes; more are met by a metric join.
BROADCAST_BYTES = 64 << 20

CENTROIDS = "cluster int, c array<double>, n long"


class Leaders:
    """Leader clustering by cosine distance of weighted vectors: one within ``reach`` of a centroid joins it, else it leads.

    Summaries merge: leaders of another summary are weighted vectors like any others.
    """

    def __init__(self, threshold: float):
        self.reach = 1 - threshold
        self.means, self.unit, self.weight, self.size = np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), 0

    @property
    def centroids(self) -> np.ndarray:
        return self.means[: self.size]

    @property
    def counts(self) -> np.ndarray:
        return self.weight[: self.size].astype(np.int64)

    def _lead(self, v: np.ndarray, w: float) -> int:
        if self.size == len(self.means):
            room = max(16, 2 * self.size)
            grow = lambda a: np.concatenate([a.reshape(self.size, len(v)), np.zeros((room - self.size, len(v)))])
            self.means, self.unit, self.weight = grow(self.means), grow(self.unit), np.concatenate([self.weight, np.zeros(room - self.size)])
        self.means[self.size], self.unit[self.size], self.weight[self.size] = v, unit(v), w
        self.size += 1
        return self.size - 1

    def merge(self, chunk: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Vectors in order. Joins are folded into the weighted means at the chunk's end; new leaders can be joined at once.

        One product compares the chunk with the leaders there are; what joins none of them is compared with each new
        leader as it appears, so there is a step for each new leader, not for each vector.
        """
        weight = np.ones(len(chunk)) if weight is None else weight
        rows = unit(chunk)
        there = np.linalg.norm(chunk, axis=1) > 0
        near, best = np.full(len(chunk), -1), np.full(len(chunk), np.inf)
        if self.size:
            dist = 1 - rows @ self.unit[: self.size].T
            near = dist.argmin(axis=1)
            best = dist[np.arange(len(chunk)), near]
        leads = np.zeros(len(chunk), dtype=bool)
        at = 0
        while True:
            free = np.flatnonzero(there[at:] & (best[at:] >= self.reach))
            if not len(free):
                break
            at += int(free[0])
            new = self._lead(chunk[at], weight[at])
            leads[at], best[at] = True, -1.0
            later = 1 - rows[at + 1 :] @ self.unit[new]
            closer = np.flatnonzero(later < best[at + 1 :]) + at + 1
            near[closer], best[closer] = new, later[closer - at - 1]
            at += 1
        joins = np.flatnonzero(there & ~leads)
        if len(joins):
            order = joins[np.argsort(near[joins], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
            named = near[order][first]
            added = np.add.reduceat(weight[order], first)
            sums = np.add.reduceat(chunk[order] * weight[order][:, None], first, axis=0)
            total = self.weight[named] + added
            self.means[named] = (self.means[named] * self.weight[named][:, None] + sums) / total[:, None]
            self.unit[named], self.weight[named] = unit(self.means[named]), total

    def collapse(self) -> None:
        """Of every two near centroids the one with the smaller count goes (on a tie the later), all at once."""
        if self.size < 2:
            return
        u, n = self.unit[: self.size], self.weight[: self.size]
        gone = np.zeros(self.size, dtype=bool)
        for at in range(0, self.size, CHUNK_ROWS):
            i, j = np.nonzero(1 - u[at : at + CHUNK_ROWS] @ u.T < self.reach)
            i += at
            i, j = i[i < j], j[i < j]
            gone[np.where(n[i] < n[j], i, j)] = True
        keep = np.flatnonzero(~gone)
        self.means, self.unit, self.weight, self.size = self.means[keep], self.unit[keep], self.weight[keep], len(keep)


def _by_task(vectors: DataFrame, threshold: float) -> DataFrame:
    """(task, nth, c, n): the leaders of each task's vectors (vec, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, task = Leaders(threshold), -1
        for batch in batches:
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
                for at in range(0, batch.num_rows, CHUNK_ROWS):
                    part = batch.slice(at, CHUNK_ROWS)
                    leaders.merge(matrix(part.column(1), part.num_rows), part.column(2).to_numpy().astype(float))
        if leaders.size:
            c = leaders.centroids
            flat = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), task)), pa.array(np.arange(len(c))), flat, pa.array(leaders.counts)], names=["task", "nth", "c", "n"])

    return vectors.mapInArrow(run, "task long, nth long, c array<double>, n long")


def leader_clusters(vectors: DataFrame, threshold: float, part_rows: int = PART_ROWS, seed: int = 1) -> DataFrame:
    """(cluster, c, n), the largest first: centroids of (bin, vec), no two of them within 1 - threshold of each other.

    Every vector takes part. Each task clusters the vectors that a hash gives it, in order of another hash, so the result
    depends on the vectors and the seed only; a task's leaders are weighted vectors. Then leaders meet in a metric join,
    and of those that are near one another the locally heaviest take in their neighbours, until none are near; the counts
    add up to the vectors. Nothing is gathered on the driver or in one task. Vectors of zeros have no direction and are
    left out; repeated vectors count as often as they come.
    """
    total = vectors.count()
    tasks = max(1, -(-total // part_rows))
    hashed = vectors.select(
        F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(tasks)).alias("task"), F.col("vec").cast("array<double>").alias("vec"), F.lit(1).cast("long").alias("n"), F.xxhash64("bin", F.lit(seed + 1)).alias("at"), "bin"
    )
    dealt = hashed.repartitionByRange(tasks, "task").sortWithinPartitions("task", "at", "bin")
    found = stored(_by_task(dealt.select("task", "vec", "n"), threshold), "leaders")
    order = [F.desc("n"), F.asc("task"), F.asc("nth")]
    leaders = numbered(found, order, "cluster").select(F.col("cluster").cast("int").alias("cluster"), "c", "n")
    return merged_leaders(stored(leaders, "leaders-numbered"), threshold)


def merged_leaders(leaders: DataFrame, threshold: float) -> DataFrame:
    """Centroids (cluster, c, n) numbered by count, until no two are near: those without a heavier near one take in their
    near ones, each of which goes to the nearest such. A round ends at least one pair, so there are finitely many."""
    reach = 1 - threshold
    while True:
        vectors = leaders.select(F.col("cluster").alias("other"), F.col("c").alias("vec"))
        pairs = metric.near(vectors, "other", leaders, reach).where("cluster < other")  # the smaller number is the heavier
        pairs = stored(pairs.select("other", "cluster", "dist"), "leader-pairs")
        if not pairs.take(1):
            return leaders
        lighter = pairs.select("other").distinct()
        taken = pairs.join(lighter.withColumnRenamed("other", "cluster"), "cluster", "left_anti")
        into = taken.groupBy("other").agg(F.min_by("cluster", F.struct("dist", "cluster")).alias("into"))
        moved = leaders.join(into.withColumnRenamed("other", "cluster"), "cluster", "left").withColumn("into", F.coalesce("into", "cluster"))
        cells = moved.select("into", "n", F.posexplode("c").alias("dim", "x")).groupBy("into", "dim").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        means = cells.groupBy("into").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("c"))
        sums = moved.groupBy("into").agg(F.sum("n").alias("n"))
        renumbered = numbered(means.join(sums, "into"), [F.desc("n"), F.asc("into")], "cluster")
        leaders = stored(renumbered.select(F.col("cluster").cast("int").alias("cluster"), "c", "n"), "leaders-merged")


def assign_nearest(vectors: DataFrame, centroids: DataFrame, threshold: float, nearest: int = NEAREST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(bin, cluster, rank, dist): up to ``nearest`` centroids (cluster, c) closer than 1 - threshold, nearest first, ties by cluster.

    Centroids of up to ``broadcast_bytes`` go to all tasks, one matrix product for each batch; more meet the vectors in a
    metric join. The centroids should be a written table.
    """
    size = centroids.agg(F.sum(8 * F.size("c"))).first()[0] or 0
    if size > broadcast_bytes:
        return metric.near(vectors, "bin", centroids, 1 - threshold, nearest).select("bin", "cluster", "rank", "dist")
    got = centroids.select("cluster", "c").orderBy("cluster").collect()
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["cluster"] for r in got]), np.array([r["c"] for r in got], dtype=float)))
    kind = dict(vectors.dtypes)["bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, theirs = shared.value
        theirs = unit(theirs) if len(ids) else theirs
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            rows = unit(matrix(batch.column(1), batch.num_rows))
            dist = 1 - rows @ theirs.T
            order = np.argsort(dist, axis=1, kind="stable")[:, :nearest]
            close = np.take_along_axis(dist, order, 1)
            row, rank = np.nonzero(close < 1 - threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(ids[order[row, rank]], pa.int32()), pa.array(rank + 1, pa.int32()), pa.array(close[row, rank])],
                names=["bin", "cluster", "rank", "dist"],
            )

    return vectors.select("bin", "vec").mapInArrow(run, f"bin {kind}, cluster int, rank int, dist double")


def near_pairs(centroids: DataFrame, threshold: float) -> DataFrame:
    """(i, j, dist, loser) of centroid pairs closer than 1 - threshold, i < j; the one with the smaller count loses, on a tie j.

    Pairs are found by a metric join of the centroids (cluster, c, n) with themselves.
    """
    centroids = stored(centroids.select("cluster", "c", "n"), "centroids")
    pairs = metric.near(centroids.select(F.col("cluster").alias("i"), F.col("c").alias("vec")), "i", centroids, 1 - threshold).where("i < cluster")
    counts = lambda name: centroids.select(F.col("cluster").alias(name), F.col("n").alias(f"n_{name}"))
    counted = pairs.withColumnRenamed("cluster", "j").join(counts("i"), "i").join(counts("j"), "j")
    return counted.select("i", "j", "dist", F.when(F.col("n_i") < F.col("n_j"), F.col("i")).otherwise(F.col("j")).alias("loser"))


def collapsed(centroids: DataFrame, threshold: float) -> DataFrame:
    """Centroids that lose to none."""
    losers = near_pairs(centroids, threshold).select(F.col("loser").alias("cluster")).distinct()
    return centroids.join(losers, "cluster", "left_anti")


def inverted(members: DataFrame) -> DataFrame:
    """(bin, clusters): each bin's clusters in order."""
    return members.groupBy("bin").agg(F.sort_array(F.collect_list("cluster")).alias("clusters"))


def cluster_priors(members: DataFrame, weights: DataFrame, samples: int, hash_size: int) -> DataFrame:
    """(cluster, size, prob): a cluster's share of the weight of all 2**hash_size bins; bins not seen weigh log2(N + 2) each."""
    seen = weights.agg(F.sum("gw").alias("s"), F.count("*").alias("k"))
    total = seen.select((F.col("s") + (F.lit(float(1 << hash_size)) - F.col("k")) * F.log2(F.lit(float(samples + 2)))).alias("total"))
    sums = members.join(weights, "bin").groupBy("cluster").agg(F.count("*").alias("size"), F.sum("gw").alias("w"))
    return sums.crossJoin(F.broadcast(total)).select("cluster", "size", (F.col("w") / F.col("total")).alias("prob"))


def recentred(vectors: DataFrame, threshold: float, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(centroids, members) by repeated rounds: assign every vector to its nearest centroid, take the means of unit vectors as
    the next centroids, merge near ones, and let vectors that fit nowhere found clusters of their own; the last round
    allows NEAREST fits. Starts from the leaders."""
    directions = vectors.select("bin", F.col("vec").cast("array<double>").alias("vec")).where(F.exists("vec", lambda x: x != 0))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    directions = stored(directions.withColumn("_size", size).select("bin", F.transform("vec", lambda x: x / F.col("_size")).alias("vec")), "directions")
    centroids = leader_clusters(directions, threshold, seed=seed)
    for _ in range(rounds - 1):
        members = stored(assign_nearest(directions, centroids, threshold, 1), "recentred-members")
        rows = directions.join(members.select("bin", "cluster"), "bin")
        cells = rows.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
        means = cells.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("c")).join(members.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
        alone = directions.join(members.select("bin"), "bin", "left_anti")
        if alone.take(1):
            last = (centroids.agg(F.max("cluster")).first()[0] or 0) + 1
            founded = leader_clusters(alone, threshold, seed=seed).select((F.col("cluster") + last).cast("int").alias("cluster"), "c", "n")
            means = means.unionByName(founded)
        renumbered = numbered(means, [F.desc("n"), F.asc("cluster")], "at").select(F.col("at").cast("int").alias("cluster"), "c", "n")
        centroids = merged_leaders(stored(renumbered, "recentred"), threshold)
    return centroids, assign_nearest(directions, centroids, threshold)
