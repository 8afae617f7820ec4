"""Read pairs: splitting, repair, interleaving, collisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored


def split_mates(rows: DataFrame, key: str, mate: str) -> DataFrame:
    """(key, kind): ``pair`` where a key has both mates 1 and 2, else ``single``; and the number of rows of each mate."""
    n = rows.groupBy(key).agg(F.count_if(F.col(mate) == 1).alias("n1"), F.count_if(F.col(mate) == 2).alias("n2"))
    return n.select(key, F.when((F.col("n1") > 0) & (F.col("n2") > 0), "pair").otherwise("single").alias("kind"), "n1", "n2")


def neighbours_paired(rows: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """Rows with ``paired``: whether the row before or after in order has the same pair key."""
    near = Window.partitionBy(*group).orderBy(order)
    before, after = F.lag(key).over(near), F.lead(key).over(near)
    return rows.withColumn("paired", F.coalesce(before == F.col(key), F.lit(False)) | F.coalesce(after == F.col(key), F.lit(False)))


def repaired(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both mates whose key is in both, as one table."""
    both = first.select(key).distinct().join(second.select(key).distinct(), key)
    return first.join(both, key, "left_semi").unionByName(second.join(both, key, "left_semi"))


def repair_ratio(first: DataFrame, second: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """(n1, n2, kept1, kept2, accepted): accepted if both keep more than the share."""
    counts = lambda a, b, n, k: a.join(b.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(F.count("*").alias(n), F.count("_in").alias(k))
    both = counts(first, second, "n1", "kept1").crossJoin(counts(second, first, "n2", "kept2"))
    ok = (F.col("kept1") > least * F.col("n1")) & (F.col("kept2") > least * F.col("n2"))
    return both.select("n1", "n2", "kept1", "kept2", ok.alias("accepted"))


def interleaved(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """Both mates in the order 1, 2, 1, 2: rows with ``mate`` and a sort key (order, mate)."""
    return first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2))).orderBy(order, "mate")


#: Distinct k-mers of a block of a bin, and blocks up to which a bin is compared block by block.
BLOCK_KMERS = 1024


def collision_blocks(kmers: DataFrame, block: int = BLOCK_KMERS) -> DataFrame:
    """(bin, part, blocks, kmers, n): a bin's distinct k-mers in blocks that a hash deals, of about so many each."""
    sizes = kmers.groupBy("bin").agg(F.count("*").alias("_k"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_k") / block)).cast("long")
    dealt = kmers.join(sizes, "bin").withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("kmer"), F.col("blocks")))
    members = F.collect_list(F.struct("kmer", "n"))
    grouped = dealt.groupBy("bin", "part", "blocks").agg(members.alias("m"))
    return grouped.select("bin", "part", "blocks", F.col("m.kmer").alias("kmers"), F.col("m.n").alias("n"))


def _differences(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, k: int, total: list[int]) -> None:
    """Adds the weighed pairs of two blocks (code points, k-mers by places) to a histogram of distances."""
    # letters of both blocks as small numbers: a comparison is of bytes
    letters = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    if len(letters) <= 256:
        a, b = (np.searchsorted(letters, x).astype(np.uint8) for x in (a, b))
    across = np.ascontiguousarray(b.T)
    most = int(na.max()) * int(nb.max())
    plain = float(most) * len(a) * len(b) < 1 << 53  # sums of weights are exact in doubles
    for at in range(0, len(a), 256):
        part, weight = a[at : at + 256], na[at : at + 256]
        apart = np.zeros((len(part), len(b)), dtype=np.uint8 if k < 255 else np.int16)
        for j in range(k):
            apart += part[:, j, None] != across[j]
        if same:  # each pair once
            apart[np.arange(at, at + len(part))[:, None] >= np.arange(len(b))[None, :]] = k + 1
        if plain:
            sums = np.bincount(apart.ravel(), weights=np.multiply.outer(weight, nb).ravel() if most > 1 else None, minlength=k + 2)
            for d in range(k + 1):
                total[d] += int(sums[d])
            continue
        for d in np.flatnonzero(np.bincount(apart.ravel(), minlength=k + 2)[: k + 1]):
            total[d] += int((weight[:, None] * nb[None, :])[apart == d].sum())


def collision_histogram(kmers: DataFrame, k: int, block: int = BLOCK_KMERS) -> DataFrame:
    """(distance, n_pairs): Hamming distances of pairs of k-mers in one bin; rows (bin, kmer, n), a row for each distinct k-mer.

    Pairs are weighed by how often each k-mer comes; equal k-mers make pairs of distance 0. The last edge is included: k
    counts with k - 1. A bin's k-mers lie in blocks, and every two blocks of a bin are a row of their own, dealt by bin and
    block pair, so a large bin is the work of many tasks; a task hands on its histogram, and no pair is ever a row.
    """
    # made once: sizes, blocks and equal pairs all read it
    kmers = stored(kmers.select("bin", "kmer", "n"), "collision-kmers")
    equal = kmers.select(F.lit(0).alias("distance"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("p"))
    blocks = stored(collision_blocks(kmers, block), "collision-blocks")
    # blocks x and y, x <= y, meet where x has a row for each y and y for each x
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = blocks.select("bin", F.col("part").alias("x"), other.alias("y"), "kmers", "n").where("x <= y")
    second = blocks.select("bin", F.col("part").alias("y"), other.alias("x"), F.col("kmers").alias("kmers2"), F.col("n").alias("n2")).where("x <= y")
    met = first.join(second, ["bin", "x", "y"]).select((F.col("x") == F.col("y")).alias("same"), "kmers", "n", "kmers2", "n2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (k + 1)
        codes = lambda x: np.frombuffer("".join(x.values.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, k)
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                if same and len(batch.column(1)[i]) < 2:
                    continue
                a, na = codes(batch.column(1)[i]), batch.column(2)[i].values.to_numpy()
                b, nb = (a, na) if same else (codes(batch.column(3)[i]), batch.column(4)[i].values.to_numpy())
                _differences(a, b, na, nb, same, k, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.arange(k + 1), k - 1), pa.int32()), pa.array(total, pa.int64())], names=["distance", "p"])

    return equal.unionByName(met.mapInArrow(run, "distance int, p long")).groupBy("distance").agg(F.sum("p").alias("n_pairs")).where("n_pairs > 0")


def split_libraries(reads: DataFrame) -> DataFrame:
    """Reads with ``lib``: their id without its sign, up to the first ``.``."""
    return reads.withColumn("lib", F.substring_index(F.expr("substring(id, 2)"), ".", 1))
