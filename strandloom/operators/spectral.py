"""Covariance of samples and the eigenspace of k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The Gram matrix of up to so many samples is solved on the driver (128 MB); see ``svd.decompose`` for more.
MOST_SAMPLES = 4000


def sample_names(conditioned: DataFrame) -> list[str]:
    """Samples in order, for what is solved on the driver; more than MOST_SAMPLES are refused (``svd.decompose`` takes them)."""
    names = [r[0] for r in conditioned.select("sample").distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: their Gram matrix isn't solved on the driver")
    return names


def _by_bin(conditioned: DataFrame, names: list[str]) -> DataFrame:
    """(bin, i, x, nth): entries with the sample's number, those of a bin behind one another in one partition.

    The window asks for just that order, which a join by bin below it already has in part.
    """
    numbers = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)]) if names else F.lit(None).cast("map<string,int>")
    rows = conditioned.select("bin", numbers[F.col("sample")].alias("i"), "x")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("bin").orderBy("i")))


def whole_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, row, sample numbers, values) of runs of whole bins; row counts the bins of a run."""
    held: list[pa.RecordBatch] = []

    def told(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        i, x, nth = (table.column(k).to_numpy() for k in (1, 2, 3))
        return table.column(0).filter(pa.array(nth == 1)).combine_chunks(), np.cumsum(nth == 1) - 1, i, x

    for batch in batches:
        starts = np.flatnonzero(batch.column(3).to_numpy() == 1)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        if held or last:
            yield told([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held and sum(h.num_rows for h in held):
        yield told(held)


def gram(conditioned: DataFrame, chunk: int = 4096) -> DataFrame:
    """(sample_i, sample_j, g) for sample_i <= sample_j: sums of products over bins.

    The samples' names are collected first, so ``conditioned`` should be a written table.
    Rows meet once, by bin. A task adds up the products of its bins in one samples-by-samples matrix and hands on
    that matrix alone, so what is shuffled then is a matrix for each task, however many bins there are.
    """
    names = sample_names(conditioned)
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n, n)), np.zeros((n, n), dtype=bool)
        for bins, row, i, x in whole_bins(batches):
            for at in range(0, len(bins), chunk):
                a, b = np.searchsorted(row, [at, at + chunk])
                dense = np.zeros((min(chunk, len(bins) - at), n))
                dense[row[a:b] - at, i[a:b]] = x[a:b]
                total += dense.T @ dense
                there = (dense != 0).astype(np.float32)
                seen |= there.T @ there > 0
        i, j = np.nonzero(np.triu(seen))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "g"])

    sums = _by_bin(conditioned, names).mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    named = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    return sums.select(F.get(named, F.col("i")).alias("sample_i"), F.get(named, F.col("j")).alias("sample_j"), "g")


def eigenspace(gram_rows: DataFrame, rank: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Samples, U (samples x rank) and singular values, largest first; rank defaults to four fifths of the samples."""
    names = sample_names(gram_rows.select(F.col("sample_i").alias("sample")))
    g = np.zeros((len(names), len(names)))
    got = gram_rows.select("sample_i", "sample_j", "g").toArrow()
    i, j = (pc.index_in(got.column(c), pa.array(names, got.column(c).type)).to_numpy() for c in (0, 1))
    g[i, j] = g[j, i] = got.column(2).to_numpy()
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][: rank if rank is not None else max(1, 4 * len(names) // 5)]
    return names, vectors[:, order], np.sqrt(np.maximum(values[order], 0))


def eigenspace_frame(spark: SparkSession, names: list[str], u: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """The eigenspace as rows (dim, sample, u, s), so that later bins are projected without a new decomposition."""
    rows = [(d, name, float(u[i, d]), float(sigma[d])) for d in range(u.shape[1]) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "dim int, sample string, u double, s double")


def load_eigenspace(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Samples, U and singular values of stored rows; samples times rank values, which ``MOST_SAMPLES`` bounds."""
    got = rows.collect()
    names = sorted({r["sample"] for r in got})
    at, rank = {n: i for i, n in enumerate(names)}, 1 + max((r["dim"] for r in got), default=-1)
    u, sigma = np.zeros((len(names), rank)), np.zeros(rank)
    for r in got:
        u[at[r["sample"]], r["dim"]], sigma[r["dim"]] = r["u"], r["s"]
    return names, u, sigma


def projected(conditioned: DataFrame, names: list[str], u: np.ndarray) -> DataFrame:
    """(bin, vec): each bin's vector over samples times U, unscaled. U (samples by rank) goes with the kernel."""
    kind = dict(conditioned.dtypes)["bin"]
    rank = u.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, row, i, x in whole_bins(batches):
            vec = np.add.reduceat(u[i] * x[:, None], np.searchsorted(row, np.arange(len(bins))), axis=0)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(vec.ravel()), rank).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([bins, flat], names=["bin", "vec"])

    return _by_bin(conditioned, names).mapInArrow(run, f"bin {kind}, vec array<double>")
