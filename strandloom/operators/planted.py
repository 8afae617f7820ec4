"""Planted sequences in reads, by minimisers and exact verification.

Of every W consecutive k-mers of a sequence the one with the smallest hash is its minimiser. Two sequences with a common
stretch of W + k - 1 characters have the same k-mers there, and so a minimiser in common at the same place of it. Reads and
planted sequences meet in a join of minimisers; what meets is compared character by character around the place, and the
longest common stretch through it counts if it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmer import spread_out
from ..plans.stored import stored

K, STRETCH = 15, 50
#: Windows of a text that are looked at together, and seeds that are handed on together (and what one more piece adds to them).
PIECE, HELD_SEEDS = 1 << 15, 1 << 13
#: Bytes of an Arrow batch, at most: a worker holds two. A longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Seeds that more places than this have are met apart, with the reads' side salted.
SALTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k characters."""
    n = max(0, len(codes) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + n].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Of every w consecutive hashes the place of the first smallest, each place once."""
    if len(h) < w:
        return np.zeros(0, dtype=np.int64)
    out = []
    for at in range(0, len(h) - w + 1, 1 << 16):
        windows = np.lib.stride_tricks.sliding_window_view(h[at : at + (1 << 16) + w - 1], w)
        out.append(np.unique(at + np.arange(len(windows)) + windows.argmin(axis=1)))
    return np.unique(np.concatenate(out))


def minimisers(codes: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the minimisers of one sequence: of every w consecutive k-mers the first with the smallest hash."""
    return _least(_hashes(codes, k), w)


def _seeds_of(text: str, k: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, seeds) of the minimisers of one text, by pieces that overlap by a stretch; each place once. Places never fall from
    window to window, so that only the last of a piece can be the first of the next."""
    last = -1
    for start in range(0, len(text) - stretch + 1, PIECE):
        h = _hashes(np.frombuffer(text[start : start + PIECE + stretch - 1].encode("utf-32-le"), dtype=np.uint32), k)
        found = _least(h, stretch - k + 1)
        at = start + found
        new = at > last
        last = int(at[-1])
        yield at[new], h[found[new]].astype(np.int64)


def seeds(texts: DataFrame, key: str, text: str, k: int, stretch: int) -> DataFrame:
    """(key, seed, at, around): minimisers of texts with up to ``stretch`` characters on each side (and the k-mer), for
    stretches of that many characters. Null and shorter texts have none. Texts are gone through in pieces and seeds handed on
    in small batches, so a worker holds an Arrow batch and one text, and little beside them."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seed, at, left, right = [], [], [], [], []

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(seed)), pa.array(np.concatenate(at), pa.int64()), pa.array(left), pa.array(right)],
                    names=[key, "seed", "at", "left", "right"],
                )

            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py() or ""
                for places, found in _seeds_of(own, k, stretch):
                    if not len(places):
                        continue
                    rows.append(np.full(len(places), i))
                    seed.append(found)
                    at.append(places)
                    for p in places.tolist():
                        left.append(own[max(0, p - stretch) : p])
                        right.append(own[p : p + k + stretch])
                    if len(left) >= HELD_SEEDS:
                        yield told()
                        rows, seed, at, left, right = [], [], [], [], []
            if rows:
                yield told()

    return spread_out(texts.select(key, text)).mapInArrow(run, f"`{key}` {kind}, seed long, at long, left string, right string")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch to BATCH_BYTES; less stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of common beginnings."""
    out = np.zeros(len(a), dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out[i] = n
            continue
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
        out[i] = lo
    return out


def planted(reads: DataFrame, key: str, sequences: DataFrame, sequence_key: str, text: str = "text", k: int = K, stretch: int = STRETCH) -> DataFrame:
    """(key, sequence_key, longest): reads with a stretch of ``stretch`` characters or more of a sequence, whole sequences and
    texts; longest is the longest such stretch, as far as ``stretch`` characters on both sides of a seed, and so at least
    ``stretch`` where it is longer. Null and shorter texts hold nothing; an empty side gives no rows. Case counts.
    Lowers the session's bytes of an Arrow batch to BATCH_BYTES.
    """
    bound_batches(reads.sparkSession)
    given = stored(seeds(sequences.where(F.col(sequence_key).isNotNull()), sequence_key, text, k, stretch), "planted-seeds")
    given = given.select(F.col(sequence_key).alias("_s"), "seed", F.col("left").alias("_l"), F.col("right").alias("_r")).dropDuplicates(["_s", "seed", "_l", "_r"])
    copies = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = seeds(reads, key, text, k, stretch).withColumn("salt", F.pmod(F.xxhash64(key, "at"), F.lit(SALTS)).cast("int"))
    met = found.join(copies, ["seed", "salt"]).select(key, "_s", "left", "right", "_l", "_r")
    kinds = dict(reads.dtypes)[key], dict(sequences.dtypes)[sequence_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, l, r = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            ahead = _common(right, r)
            size = ahead + _common([x[::-1] for x in left], [x[::-1] for x in l])
            enough = pa.array((ahead >= k) & (size >= stretch))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(enough), batch.column(1).filter(enough), pa.array(size).filter(enough)], names=[key, sequence_key, "longest"])

    pairs = met.mapInArrow(run, f"`{key}` {kinds[0]}, `{sequence_key}` {kinds[1]}, longest long")
    return pairs.groupBy(key, sequence_key).agg(F.max("longest").alias("longest"))
