"""k-mers: windows of a text or sequence, their bins, reverse complements, read ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text handled at once; a longer text is handled alone.
SLICE_CHARS = 1 << 18


def coefficients(k: int, bits: int, factor: int = 1_000_003) -> list[int]:
    """Coefficients of a window's characters: powers of a factor modulo 2**bits."""
    return [pow(factor, i, 1 << bits) for i in range(k)]


def char_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of row ranges; null counts as empty."""
    column = pc.fill_null(column, "")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < len(column):
        end = min(len(column), max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1))
        text = "".join(column.slice(row, end - row).to_pylist())
        yield row, end, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), ends[row : end + 1] - ends[row]
        row = end


def window_bins(codes: np.ndarray, offsets: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of every window of k characters inside a row: the weighted sum of its code points modulo 2**bits."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i, c in enumerate(coefficients(k, bits)):
        total += np.uint64(c) * codes[i : i + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[k - 1 : k - 1 + n]
    return row[:n][inside], (total[inside] & np.uint64((1 << bits) - 1)).astype(np.int64)


#: Counters of bins that a task holds (4 bytes each), by whole keys; what its other keys have is held as distinct (key, bin), so
#: many at most. A counter is handed on before it can overflow.
COUNTERS, HELD_BINS, MOST_WINDOWS = 24 << 20, 1_000_000, 1 << 31


def spread_out(texts: DataFrame) -> DataFrame:
    """Texts in as many partitions as there are cores at least: a small input may be one row group, and so one task."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts if texts.isStreaming or texts.rdd.getNumPartitions() >= cores else texts.repartition(cores)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their sums."""
    codes, n = (np.concatenate(x) for x in zip(*parts))
    if not len(codes):
        return codes, n
    if (codes[1:] < codes[:-1]).any():
        by = np.argsort(codes, kind="stable")
        codes, n = codes[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def bin_counts(texts: DataFrame, key: str, text: str, k: int, bits: int) -> DataFrame:
    """(key, bin, cnt): how often each key's texts have each bin."""
    return partial_counts(texts, key, text, k, bits).groupBy(key, "bin").agg(F.sum("cnt").alias("cnt"))


def partial_counts(texts: DataFrame, key: str, text: str, k: int, bits: int) -> DataFrame:
    """(key, bin, cnt) to be added up. A task has a counter for each bin of its first keys and hands on what it counted at its
    end, so each (key, bin) once; of further keys it hands on each (key, bin) once for every HELD_BINS of them."""
    kind = dict(texts.dtypes)[key]
    dense = COUNTERS >> bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict = {}
        counters = np.zeros(0, dtype=np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = windows = 0
        arrow = None

        def told(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(numbers), arrow)
            for at in range(0, len(codes), 1 << 18):
                part = codes[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part >> bits)), pa.array(part & ((1 << bits) - 1)), pa.array(n[at : at + (1 << 18)])], names=[key, "bin", "cnt"])

        def counted() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(counters), 1 << 18):
                there = np.flatnonzero(counters[at : at + (1 << 18)]) + at
                yield from told(there, counters[there].astype(np.int64))

        for batch in batches:
            arrow = batch.column(0).type
            number = np.array([numbers.setdefault(x, len(numbers)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            if len(counters) < min(len(numbers), dense) << bits:
                counters = np.concatenate([counters, np.zeros((min(len(numbers), dense) << bits) - len(counters), dtype=np.uint32)])
            for a, _, codes, offsets in char_slices(batch.column(1)):
                row, bins = window_bins(codes, offsets, k, bits)
                both = (number[a + row] << bits) | bins
                if windows + len(both) >= MOST_WINDOWS:
                    yield from counted()
                    counters[:], windows = 0, 0
                windows += len(both)
                if len(numbers) > dense:
                    rare = both[both >= len(counters)]
                    both = both[both < len(counters)]
                    held.append(np.unique(rare, return_counts=True))
                    size += len(held[-1][0])
                np.add.at(counters, both, np.uint32(1))
                if size >= HELD_BINS:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > HELD_BINS // 2:
                        yield from told(*held[0])
                        held, size = [], 0
        if held:
            yield from told(*_added(held))
        yield from counted()

    return spread_out(texts.select(key, text)).mapInArrow(run, f"`{key}` {kind}, bin long, cnt long")


#: Distinct k-mers that a task holds before it hands them on.
HELD_KMERS = 1_000_000


def packed_kmers(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed, others): windows inside rows as one 64-bit number each, where k is 8 at most and all characters are under 256,
    and the places of those that aren't."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[k - 1 : k - 1 + n]
    if k > 8:
        return np.zeros(0, np.uint64), np.flatnonzero(inside)
    wide = np.concatenate([[0], np.cumsum(codes >= 256)])
    narrow = wide[k:] == wide[:n]
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        packed = (packed << np.uint64(8)) | codes[i : i + n]
    return packed[inside & narrow], np.flatnonzero(inside & ~narrow)


def text_kmers(texts: DataFrame, text: str, k: int, bits: int) -> DataFrame:
    """(bin, kmer, n): the windows of k characters of all texts with their bins, to be added up; a task hands on each k-mer of
    characters under 256 once for every HELD_KMERS of them, others once a slice."""
    factors = coefficients(k, bits)

    def told(windows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bins = sum(np.uint64(c) * windows[:, i] for i, c in enumerate(factors)) & np.uint64((1 << bits) - 1)
        raw = windows.astype("<u4").tobytes().decode("utf-32-le")
        return pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int64)), pa.array([raw[i : i + k] for i in range(0, len(raw), k)], pa.string()), pa.array(n.astype(np.int64))], names=["bin", "kmer", "n"])

    def unpacked(packed: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(packed), 1 << 16):
            part = packed[at : at + (1 << 16)]
            yield told(np.stack([(part >> np.uint64(8 * (k - 1 - i))) & np.uint64(255) for i in range(k)], axis=1), n[at : at + (1 << 16)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, codes, offsets in char_slices(batch.column(0)):
                packed, others = packed_kmers(codes, offsets, k)
                held.append(_added([(np.sort(packed), np.ones(len(packed), dtype=np.int64))]))
                size += len(held[-1][0])
                if len(others):
                    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, k)[others])
                    _, first, n = np.unique(windows.view(np.dtype((np.void, 4 * k))).ravel(), return_index=True, return_counts=True)
                    for a in range(0, len(first), 1 << 16):
                        yield told(windows[first[a : a + (1 << 16)]].astype(np.uint64), n[a : a + (1 << 16)])
                if size >= 2 * HELD_KMERS:
                    held = [_added(held)]
                    size = len(held[0][0])
                    if size > HELD_KMERS:
                        yield from unpacked(*held[0])
                        held, size = [], 0
        if held:
            yield from unpacked(*_added(held))

    return spread_out(texts.select(text)).mapInArrow(run, "bin long, kmer string, n long")


def kmers(seq: Column, k: int) -> Column:
    """All windows of a short sequence (a read), as an array; none if it is shorter than k."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical_bin(forward: Column, backward: Column) -> Column:
    """The strand's bin that is smaller modulo a million; a tie goes to the forward strand."""
    return F.when(forward % 1_000_000 <= backward % 1_000_000, forward).otherwise(backward)


def trimmed_length(qual: Column, k: int, q_offset: int | Column = 33) -> Column:
    """Bases kept: through base i + k - 1 where i + k - 1 >= k - 1 is the third base of quality under 3 from base k - 1 on; else all.

    Base numbers count from 0; the third bad base itself is kept.
    """
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - q_offset)
    bad = F.filter(F.transform(codes, lambda q, i: F.when((q < 3) & (i >= k - 1), i)), lambda i: i.isNotNull())
    return F.when(F.size(bad) >= 3, F.element_at(bad, 3) + 1).otherwise(F.length(qual))


def mapper_windows(seq: Column, qual: Column, k: int, bad: int = 2, allowed: int = 2, q_offset: int = 33) -> Column:
    """How many windows of k bases come before the first that has more than ``allowed`` bases of quality ``bad``; all if none has."""
    places = F.filter(F.transform(F.split(qual, ""), lambda c, i: F.when(F.ascii(c) - q_offset == bad, i)), lambda i: i.isNotNull())
    # a bad base and the one so many after it lie in one window from the latter's end on back
    full = F.zip_with(F.slice(places, allowed + 1, 1 << 30), places, lambda b, a: F.when(b - a < k, F.greatest(b - (k - 1), F.lit(0))))
    every = F.greatest(F.length(seq) - (k - 1), F.lit(0))
    return F.least(every, F.coalesce(F.array_min(full), every))


def phred_probability(q: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -q / 10.0)


def read_base_id(read_id: Column, id_type: int) -> Column:
    """Id with the mate's number at its end: type 1 through the number after the blank, type 2 the first token, else starred."""
    first = F.substring_index(read_id, " ", 1)
    if id_type == 1:
        return F.regexp_extract(read_id, r"^([^ ]* .)", 1)
    return first if id_type == 2 else F.concat(first, F.lit("*"))


def pair_key(base_id: Column) -> Column:
    return base_id.substr(F.lit(1), F.length(base_id) - 1)


def mate_id(base_id: Column) -> Column:
    """The mate's id: 1 and 2 change places at the end."""
    return F.concat(pair_key(base_id), F.when(F.right(base_id, F.lit(1)) == "1", F.lit("2")).otherwise(F.lit("1")))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))
