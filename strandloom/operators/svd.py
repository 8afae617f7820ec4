"""Truncated singular value decomposition of a sparse samples-by-bins matrix of any number of samples.

Block Krylov iteration with Rayleigh-Ritz values: a block Q (samples by a few columns) is multiplied by A A^T, freed of what
the space so far has, made orthonormal by a QR decomposition over a tree of row blocks and added to the space, until the
leading values of the space stay; a space of MOST_STEPS blocks starts again from its leading vectors. The matrix is packed
once, whole bins together, so that a task multiplies its bins by A^T and A in one go and hands on one partial product. Q
goes to the tasks in groups of columns of BROADCAST_BYTES at most; the driver holds such a group and matrices of columns by
columns, nothing of the size of samples by samples.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .numbering import numbered
from .spectral import whole_bins

#: Entries of a pack, and rows (samples) of a block of the basis.
PACK_ENTRIES = 1 << 16
BLOCK_ROWS = 1024
#: Columns of the basis that are sent to all tasks at once take so many bytes.
BROADCAST_BYTES = 64 << 20
#: Singular values asked for where no rank is given, and columns beyond those asked for.
RANK, OVERSAMPLE = 200, 10
#: Products at most, and the change of the leading values (relative to the largest) at which they end.
MOST_ROUNDS, TOLERANCE = 60, 1e-12
#: Blocks of a space before it starts again.
MOST_STEPS = 8
#: Directions under this share of the largest are numerically none.
SMALLEST = 1e-13

_PACKS = "bins array<{bin}>, sizes binary, rows binary, x binary"
_BLOCK = "i int, mat binary"


def sample_numbers(conditioned: DataFrame) -> DataFrame:
    """(sample, row): samples numbered in order, as a written table."""
    return stored(numbered(conditioned.select("sample").distinct(), [F.asc("sample")], "row"), "svd-samples")


def packed(conditioned: DataFrame, samples: DataFrame) -> DataFrame:
    """(bins, sizes, rows, x): runs of whole bins with their entries, as a written table. Rows of a bin meet once."""
    kind = dict(conditioned.dtypes)["bin"]
    rows = conditioned.join(samples, "sample").select("bin", F.col("row").cast("int").alias("i"), F.col("x").cast("double").alias("x"))
    by_bin = rows.withColumn("nth", F.row_number().over(Window.partitionBy("bin").orderBy("i")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, row, i, x in whole_bins(batches):
            sizes = np.bincount(row, minlength=len(bins)).astype(np.int32)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(bins):
                start = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + PACK_ENTRIES, side="right")))
                stop = int(ends[last - 1])
                one = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), bins.slice(first, last - first))
                cells = (sizes[first:last], i[start:stop].astype(np.int32), x[start:stop].astype(np.float64))
                yield pa.RecordBatch.from_arrays([one, *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["bins", "sizes", "rows", "x"])
                first = last

    return stored(by_bin.mapInArrow(run, _PACKS.format(bin=kind)), "svd-packs")


def _cells(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where bins start, rows, values) of a pack."""
    sizes, rows, x = (np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in ((-3, np.int32), (-2, np.int32), (-1, np.float64)))
    return np.cumsum(sizes) - sizes, rows, x


class Basis:
    """A tall matrix as blocks of rows: a written table (i, mat) of ``columns`` doubles a row."""

    def __init__(self, blocks: DataFrame, rows: int, columns: int):
        self.blocks, self.rows, self.columns = blocks, rows, columns

    def groups(self) -> list[tuple[int, int]]:
        """Ranges of columns that are sent at once."""
        width = max(1, min(self.columns, BROADCAST_BYTES // (8 * max(1, self.rows))))
        return [(a, min(self.columns, a + width)) for a in range(0, self.columns, width)]

    def sent(self, a: int, b: int) -> np.ndarray:
        """Columns a to b, for a broadcast."""
        part = _mapped(self.blocks, lambda i, m: m[:, a:b], self.columns)
        out = np.zeros((self.rows, b - a))
        for i, raw in zip(*part.toArrow().columns):
            m = np.frombuffer(raw.as_buffer()).reshape(-1, b - a)
            at = i.as_py() * BLOCK_ROWS
            out[at : at + len(m)] = m
        return out


def _mapped(blocks: DataFrame, f: Callable[[int, np.ndarray], np.ndarray], columns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                i = batch.column(0)[n].as_py()
                mat = f(i, np.frombuffer(batch.column(1)[n].as_buffer()).reshape(-1, columns))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([np.ascontiguousarray(mat).tobytes()], pa.binary())], names=["i", "mat"])

    return blocks.select("i", "mat").mapInArrow(run, _BLOCK)


def random_basis(spark: SparkSession, rows: int, columns: int, seed: int) -> Basis:
    """Normal numbers that depend on seed and block only."""
    ids = spark.range(-(-rows // BLOCK_ROWS)).select(F.col("id").cast("int").alias("i"), F.lit(b"").alias("mat"))

    def block(i: int, _: np.ndarray) -> np.ndarray:
        size = min(BLOCK_ROWS, rows - i * BLOCK_ROWS)
        return np.random.default_rng([seed, i]).normal(size=(size, columns))

    return Basis(stored(_mapped(ids, block, max(1, columns)), "svd-random"), rows, columns)


def _folded(blocks: DataFrame, columns: int, shape: Callable[[], np.ndarray], add: Callable[[np.ndarray, tuple[np.ndarray, ...]], np.ndarray], names: tuple[str, ...]) -> list[np.ndarray]:
    """What ``add`` makes of all the blocks, a small matrix for each of at most 64 tasks' worth of partial results."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shape()
        for batch in batches:
            for n in range(batch.num_rows):
                total = add(total, tuple(np.frombuffer(batch.column(c)[n].as_buffer()).reshape(-1, columns) for c in range(len(names))))
        if total.size:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["mat"])

    return blocks.select(*names).mapInArrow(first, "mat binary")


def orthonormal(basis: Basis, passes: int = 2) -> Basis:
    """An orthonormal basis of the same columns' span; directions that are numerically none are left out.

    R comes from a tree: each task keeps the R of its row blocks, tasks' Rs are stacked by a few tasks and then on the
    driver. Q is W V / s with the singular values of R; a second pass mends what rounding has left.
    """
    for _ in range(passes):
        c = basis.columns
        stack = lambda total, mats: np.linalg.qr(np.concatenate([total, *mats]), mode="r")
        parts = _folded(basis.blocks, c, lambda: np.zeros((0, c)), stack, ("mat",))  # noqa: B023
        parts = _folded(parts.repartition(max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)), c, lambda: np.zeros((0, c)), stack, ("mat",))  # noqa: B023
        rs = [np.frombuffer(r["mat"]).reshape(-1, c) for r in parts.collect()]
        if not rs:
            return Basis(basis.blocks, basis.rows, 0)
        _, s, vt = np.linalg.svd(np.linalg.qr(np.concatenate(rs), mode="r"))
        keep = s > SMALLEST * max(s[0], 1e-300)
        turn = vt[: len(s)][keep].T / s[keep]
        basis = Basis(stored(_mapped(basis.blocks, lambda i, m: m @ turn, c), "svd-basis"), basis.rows, int(keep.sum()))  # noqa: B023
    return basis


def times_square(packs: DataFrame, basis: Basis) -> Basis:
    """A A^T times the basis. A task's partial product is one matrix of all samples it has seen, for each group of columns."""
    spark, rows, groups = packs.sparkSession, basis.rows, basis.groups()
    parts = None
    for g, (a, b) in enumerate(groups):
        sent = spark.sparkContext.broadcast(basis.sent(a, b))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, g=g) -> Iterator[pa.RecordBatch]:
            q = sent.value
            total, seen = np.zeros_like(q), np.zeros(-(-rows // BLOCK_ROWS), dtype=bool)
            for batch in batches:
                for n in range(batch.num_rows):
                    starts, at, x = _cells(batch, n)
                    if not len(at):
                        continue
                    z = np.add.reduceat(q[at] * x[:, None], starts, axis=0)
                    back = np.repeat(z, np.diff(np.concatenate([starts, [len(at)]])), axis=0) * x[:, None]
                    order = np.argsort(at, kind="stable")
                    named = at[order]
                    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
                    total[named[first]] += np.add.reduceat(back[order], first, axis=0)
                    seen[named[first] // BLOCK_ROWS] = True
            for i in np.flatnonzero(seen):
                m = total[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["i", "g", "mat"])

        part = packs.select("sizes", "rows", "x").mapInArrow(run, "i int, g int, mat binary")
        parts = part if parts is None else parts.unionByName(part)
    widths = [b - a for a, b in groups]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of one block's parts, which stand behind one another, with the groups of columns side by side."""
        at, total = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.concatenate(total, axis=1).tobytes()], pa.binary())], names=["i", "mat"])

        for batch in batches:
            for n in range(batch.num_rows):
                i, g = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                if i != at:
                    if at is not None:
                        yield told()
                    size = min(BLOCK_ROWS, rows - i * BLOCK_ROWS)
                    at, total = i, [np.zeros((size, w)) for w in widths]
                total[g] += np.frombuffer(batch.column(2)[n].as_buffer()).reshape(-1, widths[g])
        if at is not None:
            yield told()

    summed = parts.repartition("i").sortWithinPartitions("i").mapInArrow(added, _BLOCK)
    return Basis(stored(summed, "svd-product"), rows, basis.columns)


def _inner(both: DataFrame, c: int, d: int) -> np.ndarray:
    """mat^T other of blocks (mat, other) of c and d columns, added up by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, d))
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                total += np.frombuffer(x.as_buffer()).reshape(-1, c).T @ np.frombuffer(y.as_buffer()).reshape(-1, d)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["mat"])

    parts = both.select("mat", "other").mapInArrow(run, "mat binary")
    return sum((np.frombuffer(r["mat"]).reshape(c, d) for r in parts.toLocalIterator()), np.zeros((c, d)))


def _joined(space: Basis, more: Basis) -> DataFrame:
    """(i, mat, other): the blocks of two matrices side by side."""
    return space.blocks.select("i", "mat").join(more.blocks.select("i", F.col("mat").alias("other")), "i")


def _paired(both: DataFrame, c: int, d: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray], label: str) -> DataFrame:
    """(i, mat): f of the two matrices of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                made = f(*(np.frombuffer(batch.column(k)[n].as_buffer()).reshape(-1, w) for k, w in ((1, c), (2, d))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([np.ascontiguousarray(made).tobytes()], pa.binary())], names=["i", "mat"])

    return stored(both.select("i", "mat", "other").mapInArrow(run, _BLOCK), label)


def _beside(space: Basis, more: Basis) -> Basis:
    made = _paired(_joined(space, more), space.columns, more.columns, lambda x, y: np.concatenate([x, y], axis=1), "svd-space")
    return Basis(made, space.rows, space.columns + more.columns)


def _freed(product: Basis, space: Basis) -> Basis:
    """The product without what the space has of it, twice over for rounding's sake, and orthonormal."""
    for _ in range(2):
        both = _joined(space, product)
        held = _inner(both, space.columns, product.columns)
        product = Basis(_paired(both, space.columns, product.columns, lambda k, w: w - k @ held, "svd-freed"), space.rows, product.columns)  # noqa: B023
    return product


@dataclasses.dataclass
class Decomposition:
    """samples: (sample, row); u: blocks of left vectors (samples by rank); sigma: singular values, largest first; energy: the
    sum of squares of all entries, of which the squares of all singular values would be the sum."""

    samples: DataFrame
    packs: DataFrame
    u: Basis
    sigma: np.ndarray
    energy: float

    def frame(self) -> DataFrame:
        """(dim, sample, u, s), the rows that ``spectral.eigenspace_frame`` has for few samples."""
        columns, sigma = self.u.columns, self.sigma

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    mat = np.frombuffer(batch.column(1)[n].as_buffer()).reshape(-1, columns)
                    row = batch.column(0)[n].as_py() * BLOCK_ROWS + np.arange(len(mat))
                    dim = np.tile(np.arange(columns), len(mat))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(row, columns)), pa.array(dim, pa.int32()), pa.array(mat.ravel()), pa.array(sigma[dim])], names=["row", "dim", "u", "s"]
                    )

        rows = self.u.blocks.mapInArrow(run, "row long, dim int, u double, s double")
        return rows.join(self.samples, "row").select("dim", "sample", "u", "s")

    def projected(self) -> DataFrame:
        """(bin, vec): each bin's vector over samples times U. Groups of columns are made apart and put together by bin."""
        kind = self.packs.schema["bins"].dataType.elementType.simpleString()
        parts, groups = None, self.u.groups()
        if not groups:
            return self.packs.select(F.explode("bins").alias("bin"), F.array().cast("array<double>").alias("vec"))
        for g, (a, b) in enumerate(groups):
            sent = self.packs.sparkSession.sparkContext.broadcast(self.u.sent(a, b))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, width=b - a) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for n in range(batch.num_rows):
                        starts, at, x = _cells(batch, n)
                        vec = np.add.reduceat(sent.value[at] * x[:, None], starts, axis=0)
                        flat = pa.FixedSizeListArray.from_arrays(pa.array(vec.ravel()), width).cast(pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([batch.column(0)[n].values, flat], names=["bin", "vec"])

            part = self.packs.mapInArrow(run, f"bin {kind}, vec array<double>").withColumn("g", F.lit(g))
            parts = part if parts is None else parts.unionByName(part)
        if len(groups) == 1:
            return parts.select("bin", "vec")
        return parts.groupBy("bin").agg(F.flatten(F.sort_array(F.collect_list(F.struct("g", "vec")))["vec"]).alias("vec"))


def decompose(conditioned: DataFrame, rank: int | None = None, oversample: int = OVERSAMPLE, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, seed: int = 1) -> Decomposition:
    """The leading singular values and left vectors of (sample, bin, x). ``conditioned`` should be a written table.

    rank defaults to four fifths of the samples, RANK at most; fewer come back where the matrix has fewer. A table without
    rows has no values.
    """
    spark = conditioned.sparkSession
    samples = sample_numbers(conditioned)
    n = samples.count()
    packs = packed(conditioned, samples)
    energy = conditioned.agg(F.sum(F.col("x").cast("double") * F.col("x"))).first()[0] or 0.0
    rank = min(n, rank if rank is not None else min(RANK, max(1, 4 * n // 5)))
    block = orthonormal(random_basis(spark, n, min(n, rank + oversample), seed))
    space = image = None  # orthonormal columns, and A A^T times them
    before, values, vectors, steps = None, np.zeros(0), np.zeros((0, 0)), 0
    for _ in range(rounds if block.columns else 0):
        product = times_square(packs, block)
        space, image = (block, product) if space is None else (_beside(space, block), _beside(image, product))
        inner = _inner(_joined(space, image), space.columns, space.columns)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        lead, most = values[:rank], max(values[0], 1e-300)
        if space.columns >= n or before is not None and len(before) == len(lead) and np.abs(lead - before).max(initial=0) <= tolerance * most:
            break
        before, steps = lead, steps + 1
        if steps % MOST_STEPS == 0:  # the leading vectors carry on
            turn, c = vectors[:, : min(n, rank + oversample)], space.columns
            space, image = (Basis(stored(_mapped(x.blocks, lambda i, m: m @ turn, c), "svd-again"), n, turn.shape[1]) for x in (space, image))  # noqa: B023
            values, vectors = values[: turn.shape[1]], np.eye(turn.shape[1])
        free = _freed(product, space)
        size = np.sqrt(max(np.trace(_inner(_joined(free, free), free.columns, free.columns)), 0))
        block = orthonormal(free) if size > 1e-10 * most else Basis(free.blocks, n, 0)
        if not block.columns:  # the space holds all there is
            break
    basis = space if space is not None else block
    lead = values[:rank]
    keep = int((lead > SMALLEST * max(values[0] if len(values) else 0, 1e-300)).sum())
    turn = vectors[:, :keep]
    u = Basis(stored(_mapped(basis.blocks, lambda i, m: m @ turn, basis.columns), "svd-u") if keep else basis.blocks.limit(0), n, keep)
    return Decomposition(samples, packs, u, np.sqrt(np.maximum(lead[:keep], 0)), energy)
