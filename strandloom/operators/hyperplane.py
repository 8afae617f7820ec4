"""Quality-aware complex hyperplane hashing of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Coordinates of the four bases.
BASES = {"A": -1, "T": 1, "C": -1j, "G": 1j}
#: Probability of a base without a quality.
SURE = 1 - 1 / 2000

WHEELS = "w int, s int, p_re array<double>, p_im array<double>, c_re double, c_im double"
_TABLE = np.zeros(256, dtype=complex)
for _base, _value in BASES.items():
    _TABLE[ord(_base)] = _value


def coordinates(seq: str, qual: str | None = None, q_offset: int = 33) -> np.ndarray:
    """A read as complex numbers, each times the probability that its base is right; unknown bases are 0."""
    at = _TABLE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if qual is None:
        return at * SURE
    q = np.frombuffer(qual.encode("latin-1", "replace"), np.uint8).astype(float) - q_offset
    return at[: len(q)] * (1 - 10 ** (-q[: len(at)] / 10))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


#: Bytes of reads hashed at once; a longer read is hashed alone.
SLICE_BYTES = 1 << 18


def read_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of so many bytes of one of its columns, so that what a kernel holds doesn't grow with a batch."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    row = 0
    while row < batch.num_rows:
        end = min(batch.num_rows, max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def batch_coordinates(seq: pa.Array, qual: pa.Array | None, kept: np.ndarray | None, q_offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, sizes) of a batch's reads behind one another, each as ``coordinates`` has it of its upper-case bases.

    All reads are looked up at once; only a batch with letters beyond ASCII is taken read by read.
    """
    data, offsets = _bytes(seq)
    codes, starts = _bytes(qual) if qual is not None else (np.zeros(0, np.uint8), np.zeros(len(seq) + 1, np.int64))
    size = np.diff(offsets)
    there = np.zeros(len(seq), dtype=bool) if qual is None else qual.is_valid().to_numpy(zero_copy_only=False)
    if (data >= 128).any() or (codes >= 128).any():
        rows = zip(seq.to_pylist(), [None] * len(seq) if qual is None else qual.to_pylist(), [None] * len(seq) if kept is None else kept.tolist(), q_offset.tolist())
        each = [coordinates((s or "").upper()[: None if n is None else int(n)], None if q is None else q[: None if n is None else int(n)], o) for s, q, n, o in rows]
        return np.concatenate([*each, np.zeros(0, dtype=complex)]), np.array([len(c) for c in each], dtype=np.int64)
    size = size if kept is None else np.minimum(size, kept)
    size = np.where(there, np.minimum(size, np.diff(starts)), size)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    sure = np.full(len(row), SURE)
    known = there[row]
    q = codes[starts[row[known]] + place[known]].astype(float) - q_offset[row[known]]
    sure[known] = 1 - 10 ** (-q / 10)
    return _TABLE[_UPPER[data[offsets[row] + place]]] * sure, size


def plane_through(points: np.ndarray) -> tuple[np.ndarray, complex]:
    """Normal and offset of a hyperplane through k points of k complex numbers: the null vector of [points, -1]."""
    k = points.shape[1]
    rows = np.concatenate([points, -np.ones((len(points), 1))], axis=1)
    rows = np.concatenate([rows, np.zeros((max(0, k + 1 - len(rows)), k + 1))])
    null = np.linalg.svd(rows)[2][-1]
    return null[:k], complex(null[k])


def make_wheels(sample: np.ndarray, k: int, hash_size: int, wheels: int = 1, seed: int = 1) -> list[tuple]:
    """hash_size planes for each wheel, each through k points drawn from the sample of k-mer coordinates."""
    rng = np.random.default_rng(seed)
    out = []
    for w in range(wheels):
        for s in range(hash_size):
            p, c = plane_through(sample[rng.choice(len(sample), k, replace=len(sample) < k)])
            out.append((w, s, p.real.tolist(), p.imag.tolist(), c.real, c.imag))
    return out


#: Files that a sample is drawn from at most, and k-mers of a file at least.
MOST_FILES, LEAST_PER_FILE = 100, 5
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _kmer_hash(seed: int, rec_no: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number for each (record, place), the same wherever the record lies."""
    x = rec_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) + np.uint64(seed)
    for shift, factor in zip((30, 27), _MIX):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bottom_kmers(reads: DataFrame, k: int, per_file: int, seed: int = 1) -> DataFrame:
    """(sample, part, rank, seq, qual, q_offset): of each file exactly ``per_file`` k-mers, or all if it has fewer: those with
    the smallest hashes of record and place.

    A task keeps so many of each of its files and hands on no others; sketches of tasks merge by taking the smallest again, so
    the sample doesn't depend on how reads lie. Reads need sample, part, rec_no, seq and qual, and may have ``kept``
    (bases that count) and ``q_offset``.
    """
    size = F.col("kept") if "kept" in reads.columns else F.length("seq")
    offset = F.col("q_offset") if "q_offset" in reads.columns else F.lit(33)
    rows = reads.where(size >= k).select("sample", "part", "rec_no", "seq", "qual", size.cast("long").alias("size"), offset.cast("int").alias("q_offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        numbers: dict[tuple, int] = {}
        least: list[int] = []  # the largest rank that a file still takes
        for batch in (part for whole in batches for part in read_slices(whole, 3)):
            files = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            file = np.array([numbers.setdefault(f, len(numbers)) for f in files], dtype=np.int64)
            least += [np.iinfo(np.int64).max] * (len(numbers) - len(least))
            windows = batch.column(5).to_numpy() - k + 1
            row = np.repeat(np.arange(len(files)), windows)
            at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            rank = (_kmer_hash(seed, batch.column(2).to_numpy()[row], at) >> np.uint64(1)).astype(np.int64)
            near = np.flatnonzero(rank <= np.array(least, dtype=np.int64)[file][row])
            row, at, rank = row[near], at[near], rank[near]
            for i in np.unique(file[row]):
                own = np.flatnonzero(file[row] == i)
                if len(own) > per_file:
                    own = own[rank[own] <= np.partition(rank[own], per_file - 1)[per_file - 1]]
                cut = lambda c: pa.array([None if (s := batch.column(c)[int(row[j])].as_py()) is None else s[at[j] : at[j] + k] for j in own], pa.string())  # noqa: B023, E731
                part = pa.table({
                    "rank": pa.array(rank[own]), "rec_no": batch.column(2).take(pa.array(row[own])), "at": pa.array(at[own], pa.int64()),
                    "seq": cut(3), "qual": cut(4), "q_offset": batch.column(6).take(pa.array(row[own])),
                })
                name = files[int(row[own[0]])]
                both = pa.concat_tables([held[name], part]) if name in held else part
                held[name] = both.sort_by([("rank", "ascending"), ("rec_no", "ascending"), ("at", "ascending")]).slice(0, per_file).combine_chunks()
                if held[name].num_rows == per_file:
                    least[i] = held[name].column("rank")[-1].as_py()
        for (sample, part), table in held.items():
            for piece in table.combine_chunks().to_batches():
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([sample] * n, pa.string()), pa.array([part] * n, pa.string()), *piece.columns], names=["sample", "part", *piece.schema.names])

    kept = rows.mapInArrow(run, "sample string, part string, rank long, rec_no long, at long, seq string, qual string, q_offset int")
    nth = F.row_number().over(Window.partitionBy("sample", "part").orderBy("rank", "rec_no", "at"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= per_file).select("sample", "part", "rank", "seq", "qual", "q_offset")


def sample_kmers(reads: DataFrame, k: int, total: int, q_offset: int = 33, seed: int = 1) -> np.ndarray:
    """Coordinates of k-mers to train the planes on: total / files of each file, LEAST_PER_FILE at least, from MOST_FILES files
    at most, which a hash chooses. The driver gets that many short rows."""
    files = reads.select("sample", "part").distinct().orderBy(F.xxhash64("sample", "part", F.lit(seed)), "sample", "part").limit(MOST_FILES)
    names = [(r["sample"], r["part"]) for r in files.collect()]
    if not names:
        return np.zeros((0, k), dtype=complex)
    if "q_offset" not in reads.columns:
        reads = reads.withColumn("q_offset", F.lit(q_offset))
    chosen = reads.join(F.broadcast(reads.sparkSession.createDataFrame(names, "sample string, part string")), ["sample", "part"], "left_semi")
    got = bottom_kmers(chosen, k, max(total // len(names), LEAST_PER_FILE), seed).collect()
    rows = sorted((r["seq"], r["qual"] or "", r["q_offset"]) for r in got)
    return np.array([coordinates(s.upper(), q or None, o) for s, q, o in rows]).reshape(len(rows), k)


def wheels_frame(spark: SparkSession, wheels: list[tuple]) -> DataFrame:
    return spark.createDataFrame(wheels, WHEELS).orderBy("w", "s")


def load_wheels(spark: SparkSession, path: str, spoke_limit: int = 999, wheel_limit: int = 999_999) -> list[tuple]:
    rows = spark.read.schema(WHEELS).parquet(path).where((F.col("s") < spoke_limit) & (F.col("w") < wheel_limit))
    return sorted(tuple(r) for r in rows.collect())


#: Windows multiplied with the planes at once.
_BLOCK = 1 << 15


def plane_matrices(wheels: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each wheel, its planes' normals (conjugated, k by spokes) and the real parts of their offsets."""
    out = []
    for w in sorted({x[0] for x in wheels}):
        spokes = sorted(x for x in wheels if x[0] == w)
        normals = np.array([np.array(x[2]) + 1j * np.array(x[3]) for x in spokes])
        out.append((normals.conj().T, np.array([x[4] for x in spokes])))
    return out


def strand_bins(coords: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]], k: int, both_strands: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(windows, wheels) bins of coordinates and of their reverse complements, a block of windows at a time."""
    count = max(0, len(coords) - k + 1)
    ahead = np.empty((count, len(planes)), dtype=np.int64)
    back = np.empty_like(ahead) if both_strands else None
    if not count:
        return ahead, back
    every = np.lib.stride_tricks.sliding_window_view(coords, k)
    for at in range(0, count, _BLOCK):
        windows = np.ascontiguousarray(every[at : at + _BLOCK])
        for i, (normals, offset) in enumerate(planes):
            powers = 1 << np.arange(len(offset), dtype=np.int64)
            ahead[at : at + _BLOCK, i] = ((windows @ normals).real > offset) @ powers
            if both_strands:
                back[at : at + _BLOCK, i] = ((-windows[:, ::-1] @ normals).real > offset) @ powers
    return ahead, back


def window_bins(coords: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]], k: int, both_strands: bool = True, tie_forward: bool = True) -> np.ndarray:
    """(windows, wheels) bins of coordinates; see ``kmer_bins``."""
    ahead, back = strand_bins(coords, planes, k, both_strands)
    if back is None:
        return ahead
    forward = ahead % 1_000_000 <= back % 1_000_000 if tie_forward else ahead % 1_000_000 < back % 1_000_000
    return np.where(forward, ahead, back)


def kmer_bins(coords: np.ndarray, wheels: list[tuple], k: int, both_strands: bool = True, tie_forward: bool = True) -> np.ndarray:
    """(windows, wheels) bins: bit s is set where the real part of the product with plane s is over its offset's.

    Of a window and its reverse complement (reversed and negated) the bin that is smaller modulo a million
    stands; a tie goes to the window itself, or to the reverse complement without ``tie_forward`` (as streaming
    mappers did).
    """
    return window_bins(coords, plane_matrices(wheels), k, both_strands, tie_forward)


def hash_reads(reads: DataFrame, wheels: list[tuple], k: int, q_offset: int = 33, both_strands: bool = True, tie_forward: bool = True, strands: bool = False) -> DataFrame:
    """The reads with ``bins``, the bins of all their windows over all wheels. The wheels have a fixed size and are broadcast.

    Columns ``kept`` and ``q_offset``, if there are any (see ``ingest.prepared``), say how many bases of a read count
    and what its qualities start from. Reads of a slice are hashed together; windows that span two reads are left out.
    ``strands`` adds ``fwd`` and ``back``, the bins of the windows and of their reverse complements before one is chosen.
    """
    shared = reads.sparkSession.sparkContext.broadcast(wheels)
    names = reads.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in reads.dtypes) + ", bins array<long>" + (", fwd array<long>, back array<long>" if strands else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = plane_matrices(shared.value)
        for batch in batches:
            for part in read_slices(batch, names.index("seq")):
                yield hashed(part, planes)

    def hashed(batch: pa.RecordBatch, planes: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        given = lambda c: batch.column(names.index(c)) if c in names else None
        whole = lambda c, other: np.full(batch.num_rows, other) if c is None else pc.fill_null(c, other).to_numpy(zero_copy_only=False)
        kept = given("kept")
        flat, size = batch_coordinates(given("seq"), given("qual"), None if kept is None else whole(kept, 1 << 30), whole(given("q_offset"), q_offset))
        ahead, back = strand_bins(flat, planes, k, both_strands or strands)
        bins = ahead
        if both_strands:
            forward = ahead % 1_000_000 <= back % 1_000_000 if tie_forward else ahead % 1_000_000 < back % 1_000_000
            bins = np.where(forward, ahead, back)
        inside = np.arange(len(bins)) + k <= np.repeat(np.cumsum(size), size)[: len(bins)]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.maximum(size - k + 1, 0)) * len(planes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[inside].ravel())) for x in ((bins, ahead, back) if strands else (bins,))]
        return pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*names, "bins", *(["fwd", "back"] if strands else [])])

    return reads.mapInArrow(run, fields)


def paired_bins(hashed: DataFrame, pair: str = "pair_key") -> DataFrame:
    """Each read with the bins of all reads of its pair (in its sample and part): both mates carry the union."""
    of_pair = hashed.groupBy("sample", "part", pair).agg(F.flatten(F.sort_array(F.collect_list(F.struct("rec_no", "bins")))["bins"]).alias("bins"))
    return hashed.drop("bins").join(of_pair, ["sample", "part", pair])


def mapper_bins(kmers: DataFrame, wheels: list[tuple], q_offset: int = 33, both_strands: bool = True, terminals: bool = False) -> DataFrame:
    """Rows of single k-mers (seq, qual, and more; all of one length) with ``bins``, one for each wheel, as streaming mappers made
    them: a bit is set where the product with a plane is over its offset by the sign of complex numbers (of the real part, or
    of the imaginary part where that is 0), and of two strands that are equal modulo a million the reverse complement stands.
    ``terminals`` adds ``first`` and ``last``, the real and imaginary parts of the outer coordinates.
    """
    shared = kmers.sparkSession.sparkContext.broadcast(wheels)
    names = kmers.columns
    more = ", first array<double>, last array<double>" if terminals else ""
    fields = ", ".join(f"`{n}` {t}" for n, t in kmers.dtypes) + ", bins array<long>" + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {w: sorted(x for x in shared.value if x[0] == w) for w in sorted({x[0] for x in shared.value})}
        planes = [(np.array([np.array(x[2]) + 1j * np.array(x[3]) for x in g]).conj().T, np.array([complex(x[4], x[5]) for x in g])) for g in groups.values()]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, _ = batch_coordinates(batch.column(names.index("seq")), batch.column(names.index("qual")), None, np.full(batch.num_rows, q_offset))
            c = flat.reshape(batch.num_rows, -1)

            def sided(x: np.ndarray) -> np.ndarray:
                out = np.empty((len(x), len(planes)), dtype=np.int64)
                for i, (normals, offset) in enumerate(planes):
                    over = x @ normals - offset
                    bit = np.where(over.real != 0, over.real > 0, over.imag > 0)
                    out[:, i] = bit @ (1 << np.arange(len(offset), dtype=np.int64))
                return out

            bins = sided(c)
            if both_strands:
                back = sided(-c[:, ::-1])
                bins = np.where(bins % 1_000_000 < back % 1_000_000, bins, back)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(bins.ravel()), bins.shape[1]).cast(pa.list_(pa.int64()))]
            if terminals:
                lists += [pa.FixedSizeListArray.from_arrays(pa.array(np.stack([c[:, i].real, c[:, i].imag], axis=1).ravel()), 2).cast(pa.list_(pa.float64())) for i in (0, -1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*names, "bins", *(["first", "last"] if terminals else [])])

    return kmers.mapInArrow(run, fields)
