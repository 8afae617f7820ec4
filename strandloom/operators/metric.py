"""Cosine range join of many vectors with many centroids, by angles and the triangle inequality.

Angles between vectors obey the triangle inequality. A few pivots are drawn from the centroids; every centroid belongs to
its nearest pivot's cell, and a cell's centroids, sorted by their angle to the pivot, are cut into blocks. A vector at angle
a to a pivot can't be within r of a block whose angles all lie outside [a - r, a + r], so it is sent to the other blocks
only, and there compared with all. What the bounds leave is found exactly; nothing is broadcast but pivots and the blocks'
bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .numbering import numbered

#: Pivots, and centroids of a block.
PIVOTS = 64
BLOCK_CENTROIDS = 512
#: Blocks whose bounds are sent to all tasks (32 bytes each).
MOST_BLOCKS = 1_000_000
#: Vectors of a block go to so many partial joins, lest one place where many vectors lie become one task.
SALTS = 16
#: Rounding of angles.
SLACK = 1e-6


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _pivots(centroids: DataFrame, pivots: int, seed: int) -> np.ndarray:
    """Unit vectors of the centroids with the smallest hashes; a bounded number."""
    rows = centroids.select("c").orderBy(F.xxhash64(F.col("cluster"), F.lit(seed)), "cluster").limit(pivots).collect()
    return unit(np.array([r["c"] for r in rows], dtype=float)) if rows else np.zeros((0, 0))


def _blocks(centroids: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """(block, cell, lo, hi, ids, mat): blocks of centroids of one cell with the range of their angles, as a written table."""
    kind = dict(centroids.dtypes)["cluster"]
    shared = centroids.sparkSession.sparkContext.broadcast(pivots)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit(matrix(batch.column(1), batch.num_rows))
                angle = _angles(rows, shared.value)
                cell = angle.argmin(axis=1)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell]), flat], names=["cluster", "cell", "angle", "c"])

    cells = centroids.select("cluster", "c").mapInArrow(celled, f"cluster {kind}, cell int, angle double, c array<double>")
    placed = numbered(cells, [F.asc("cell"), F.asc("angle"), F.asc("cluster")])
    grouped = placed.groupBy("cell", F.floor(F.col("pos") / block).alias("at")).agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("members")
    )
    keyed = grouped.select((F.col("at") * len(pivots) + F.col("cell")).cast("long").alias("block"), "cell", "lo", "hi", F.col("members.cluster").alias("ids"), F.flatten("members.c").alias("mat"))
    return stored(keyed, "metric-blocks")


def routed(vectors: DataFrame, key: str, blocks: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """(block, keys, mat): vectors, a batch's together, for each block that they may be within reach of."""
    bounds = blocks.select("block", "cell", "lo", "hi").limit(MOST_BLOCKS + 1).toPandas()
    if len(bounds) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks of centroids: take larger blocks")
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, *(bounds[c].to_numpy() for c in ("block", "cell", "lo", "hi"))))
    kind = dict(vectors.dtypes)[key]
    radius = float(np.arccos(np.clip(1 - reach, -1, 1))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, block, cell, lo, hi = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1), batch.num_rows)
            there = np.linalg.norm(rows, axis=1) > 0
            rows = unit(rows)
            angle = _angles(rows, pivots)
            for i in range(len(block)):
                a = angle[:, cell[i]]
                near = np.flatnonzero(there & (a >= lo[i] - radius) & (a <= hi[i] + radius))
                if len(near):
                    keys = pa.ListArray.from_arrays(pa.array([0, len(near)], pa.int32()), batch.column(0).take(pa.array(near)))
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 1]), keys, pa.array([rows[near].tobytes()], pa.binary())], names=["block", "keys", "mat"])

    return vectors.select(key, "vec").mapInArrow(run, f"block long, keys array<{kind}>, mat binary")


def near(vectors: DataFrame, key: str, centroids: DataFrame, reach: float, nearest: int | None = None, pivots: int = PIVOTS, block: int = BLOCK_CENTROIDS, seed: int = 1) -> DataFrame:
    """(key, cluster, dist): pairs of a vector (key, vec) and a centroid (cluster, c) at a cosine distance under ``reach``, or of
    each vector the ``nearest`` such, with their rank; ties by cluster. Vectors of zeros are near nothing. All vectors have
    one length. An empty side gives no rows. The centroids should be a written table."""
    kinds = dict(vectors.dtypes)[key], dict(centroids.dtypes)["cluster"]
    schema = f"`{key}` {kinds[0]}, cluster {kinds[1]}, dist double"
    centroids = centroids.where(F.exists("c", lambda x: x != 0))
    picked = _pivots(centroids, pivots, seed)
    if not len(picked):
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1)) if nearest else vectors.sparkSession.createDataFrame([], schema)
    blocks = _blocks(centroids, picked, block)
    dealt = F.pmod(F.xxhash64("keys"), F.lit(SALTS))
    sent = routed(vectors, key, blocks, picked, reach).withColumn("salt", dealt)
    copies = blocks.select("block", "ids", F.col("mat").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                keys, ids = batch.column(0)[n].values, batch.column(2)[n].values
                theirs = batch.column(3)[n].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                rows = np.frombuffer(batch.column(1)[n].as_buffer()).reshape(len(keys), -1)
                dist = 1 - rows @ theirs.T
                if nearest is None:
                    row, at = np.nonzero(dist < reach)
                else:
                    order = np.argsort(dist, axis=1, kind="stable")[:, :nearest]  # ids of a block ascend
                    row, place = np.nonzero(np.take_along_axis(dist, order, 1) < reach)
                    at = order[row, place]
                if len(row):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), ids.take(pa.array(at)), pa.array(dist[row, at])], names=[key, "cluster", "dist"])

    pairs = sent.join(copies, ["block", "salt"]).select("keys", "mat", "ids", "c").mapInArrow(run, schema)
    if nearest is None:
        return pairs
    order = Window.partitionBy(key).orderBy("dist", "cluster")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= nearest)
