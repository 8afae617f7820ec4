"""Reads to clusters: k-mer evidence, likelihood ratios, memberships.

What is known of a bin (its weight and its clusters) is one row of one table, ``bin_table``. Reads meet it in one of two
ways: a table of bounded size goes to all tasks, and a read's sums are made where the read lies, without any shuffle; a
larger one is kept in buckets by bin, and only the reads' bins are shuffled to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kmer import char_slices, spread_out, window_bins
from ..functions.vectors import log_likelihood_ratio

#: A ratio over this assigns a read.
LEAST_RATIO = 3.84
#: Older path: clusters larger than this share of all bins, or with a smaller prior than this, are left out.
MOST_SHARE, LEAST_PRIOR = 0.2, 0.00002
#: A bin table up to so many bytes, at BIN_BYTES a bin and 4 a cluster of it, goes to all tasks.
LOOKUP_BYTES, BIN_BYTES = 64 << 20, 24
#: Bins of reads looked up at once, bins that a table finds by place rather than by search, and sums of rows and clusters kept densely.
SLICE_BINS, PLACES, DENSE_SUMS = 1 << 18, 16 << 20, 1 << 22


def bin_table(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(bin, gw, clusters): every weighed bin with its clusters in order, null where it has none."""
    clusters = members.groupBy("bin").agg(F.sort_array(F.collect_list("cluster")).alias("clusters"))
    return weights.select("bin", "gw").join(clusters, "bin", "left")


def table_priors(bins: DataFrame, samples: int, hash_size: int) -> DataFrame:
    """(cluster, size, prob): ``cluster.cluster_priors`` from a bin table, without a join."""
    seen = bins.agg(F.sum("gw").alias("s"), F.count("*").alias("k"))
    total = seen.select((F.col("s") + (F.lit(float(1 << hash_size)) - F.col("k")) * F.log2(F.lit(float(samples + 2)))).alias("total"))
    sums = bins.select("gw", F.explode("clusters").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("size"), F.sum("gw").alias("w"))
    return sums.crossJoin(F.broadcast(total)).select("cluster", "size", (F.col("w") / F.col("total")).alias("prob"))


def _lookup(bins: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Bins in order with their weights, where their clusters begin, and the clusters; none if they take more than ``most`` bytes."""
    size = bins.agg(F.sum(F.lit(BIN_BYTES) + 4 * F.coalesce(F.size("clusters"), F.lit(0)))).first()[0] or 0
    if size > most:
        return None
    got = bins.select(F.col("bin").cast("long").alias("bin"), F.col("gw").cast("double").alias("gw"), F.coalesce(F.col("clusters").cast("array<int>"), F.array().cast("array<int>")).alias("clusters")).toArrow().combine_chunks()
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = got.column(2).take(pa.array(order)).combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy())
    return ids[order], got.column(1).to_numpy()[order], np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False)


def _places(ids: np.ndarray) -> np.ndarray | None:
    """Where each bin is in a table, one beyond it where it isn't; none if the bins are too large for an array of places."""
    if not len(ids) or ids[0] < 0 or ids[-1] >= PLACES:
        return None
    places = np.full(int(ids[-1]) + 2, len(ids), dtype=np.int32)
    places[ids] = np.arange(len(ids), dtype=np.int32)
    return places


def _found(bin_: np.ndarray, ids: np.ndarray, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which bins a table knows, and where those are."""
    if places is not None:
        at = places[np.where(bin_ < 0, len(places) - 1, np.minimum(bin_, len(places) - 1))]
        known = at < len(ids)
    else:
        at = np.minimum(np.searchsorted(ids, bin_), max(0, len(ids) - 1))
        known = ids[at] == bin_ if len(ids) else np.zeros(len(bin_), dtype=bool)
    return known, at[known].astype(np.int64)


def _sums(row: np.ndarray, bin_: np.ndarray, rows: int, table: tuple[np.ndarray, ...], distinct: bool, places: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, cluster, m, s) of rows' bins."""
    ids, gw, begin, flat = table
    known, at = _found(bin_, ids, places)
    row = row[known]
    size = begin[at + 1] - begin[at]
    counted = np.ones(len(at), dtype=bool) if distinct else size > 0
    total = np.bincount(row[counted], weights=gw[at[counted]], minlength=rows)
    if distinct:
        both = np.sort(row * len(ids) + at)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        row, at = both // max(1, len(ids)), both % max(1, len(ids))
        size = begin[at + 1] - begin[at]
    each = np.repeat(np.arange(len(at)), size)
    cluster = flat[begin[at][each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)]
    r, w = row[each], gw[at[each]]
    if not len(r):
        return r, cluster, total[r], w
    least, wide = int(cluster.min()), int(cluster.max()) - int(cluster.min()) + 1
    if rows * wide <= DENSE_SUMS:
        code = r * wide + (cluster - least)
        there = np.flatnonzero(np.bincount(code, minlength=rows * wide))
        return there // wide, there % wide + least, total[there // wide], np.bincount(code, weights=w, minlength=rows * wide)[there]
    order = np.lexsort((cluster, r))
    r, c, w = r[order], cluster[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
    return r[first], c[first], total[r[first]], np.add.reduceat(w, first)


#: (first row, rows, row of each bin, bin) of slices of a batch.
Slices = Iterator[tuple[int, int, np.ndarray, np.ndarray]]


def _list_slices(lists: pa.ListArray) -> Slices:
    size = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, size)
    flat, ends = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BINS, side="right")) - 1)
        yield first, last - first, np.repeat(np.arange(last - first), size[first:last]), flat[ends[first] : ends[last]]
        first = last


def _text_slices(k: int, bits: int) -> Callable[[pa.Array], Slices]:
    def run(texts: pa.Array) -> Slices:
        for a, b, codes, offsets in char_slices(texts):
            yield a, b - a, *window_bins(codes, offsets, k, bits)

    return run


def _evidence_by_lookup(reads: DataFrame, column: str, slices: Callable[[pa.Array], Slices], table: tuple[np.ndarray, ...], distinct: bool) -> DataFrame:
    shared = reads.sparkSession.sparkContext.broadcast(table)
    kind = dict(reads.dtypes)["read"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(shared.value[0])
        for batch in batches:
            for first, rows, row, bins in slices(batch.column(1)):
                r, c, m, s = _sums(row, bins, rows, shared.value, distinct, places)
                if len(r):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r + first)), pa.array(c, pa.int32()), pa.array(m), pa.array(s)], names=["read", "cluster", "m", "s"])

    return reads.select("read", column).mapInArrow(run, f"read {kind}, cluster int, m double, s double")


def _kmers_of(reads: DataFrame, column: str, slices: Callable[[pa.Array], Slices]) -> DataFrame:
    kind = dict(reads.dtypes)["read"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, row, bins in slices(batch.column(1)):
                order = np.lexsort((bins, row))
                row, bins = row[order], bins[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])])) if len(row) else row
                n = np.diff(np.concatenate([new, [len(row)]]))
                if len(new):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + first)), pa.array(bins[new]), pa.array(n)], names=["read", "bin", "n"])

    return reads.select("read", column).mapInArrow(run, f"read {kind}, bin long, n long")


def read_kmers(reads: DataFrame) -> DataFrame:
    """(read, bin, n) of reads (read, bins): a read's bins and how often each comes, told where the read lies."""
    return _kmers_of(reads, "bins", _list_slices)


def evidence_by_join(kmers: DataFrame, bins: DataFrame, distinct: bool = False) -> DataFrame:
    """(read, cluster, m, s) of (read, bin, n) and a bin table, in buckets by bin if it is large. One join by bin carries both
    sums: a bin's clusters stay one array until its reads' rows have been added up."""
    rows = kmers.join(bins if distinct else bins.where("size(clusters) > 0"), "bin")
    per_set = rows.groupBy("read", "clusters").agg(F.sum(F.col("n") * F.col("gw")).alias("w"), F.sum("gw").alias("d"))
    # the row of cluster null carries the read's total
    members = F.array_append(F.coalesce("clusters", F.array().cast("array<int>")), F.lit(None).cast("int"))
    long = per_set.select("read", F.explode(members).alias("cluster"), "w", "d").repartition("read")  # for both sums below
    sums = long.groupBy("read", "cluster").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    per_read = sums.groupBy("read").agg(
        F.max(F.when(F.col("cluster").isNull(), F.col("w"))).alias("m"),
        F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", F.col("d" if distinct else "w").alias("s")))).alias("parts"),
    )
    return per_read.select("read", "m", F.inline("parts")).select("read", "cluster", "m", "s")


def read_evidence(reads: DataFrame, bins: DataFrame, distinct: bool = False, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """(read, cluster, m, s) of reads (read, bins array, one row a read) and a bin table (bin, gw, clusters).

    s is the weight of a read's bins in the cluster, m in any cluster, both with multiplicity. ``distinct`` is the older
    rule: m takes all weighed bins with multiplicity, s a cluster's distinct ones. Reads without bins have no rows, null
    bins count as none. The bin table should be a written one.
    """
    return _evidence(reads, "bins", _list_slices, bins, distinct, lookup_bytes)


def text_evidence(texts: DataFrame, k: int, bits: int, bins: DataFrame, distinct: bool = False, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """``read_evidence`` of texts (read, text), whose bins are made and summed up in one kernel and are never a column."""
    return _evidence(spread_out(texts.select("read", "text")), "text", _text_slices(k, bits), bins, distinct, lookup_bytes)


def _evidence(reads: DataFrame, column: str, slices: Callable[[pa.Array], Slices], bins: DataFrame, distinct: bool, lookup_bytes: int) -> DataFrame:
    table = _lookup(bins, lookup_bytes)
    if table is not None:
        return _evidence_by_lookup(reads, column, slices, table, distinct)
    return evidence_by_join(_kmers_of(reads, column, slices), bins, distinct)


def best_cluster(evidence: DataFrame, stats: DataFrame, least: float = LEAST_RATIO, share: float = 0.8) -> DataFrame:
    """(read, cluster, llr): the likeliest cluster of each read over the limit; of equal ones the larger number."""
    rated = evidence.join(stats.select("cluster", "prob"), "cluster").withColumn("llr", log_likelihood_ratio(F.col("m"), F.col("s"), F.col("prob"), share))
    best = rated.where(F.col("llr") > least).groupBy("read").agg(F.max(F.struct("llr", "cluster")).alias("b"))
    return best.select("read", F.col("b.cluster").alias("cluster"), F.col("b.llr").alias("llr"))


def large_files(reads: DataFrame, least: int = 50) -> DataFrame:
    """Reads of files (sample, part) that have at least so many."""
    sizes = reads.groupBy("sample", "part").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return reads.join(sizes.select("sample", "part"), ["sample", "part"], "left_semi")


def partitioned_reads(reads: DataFrame, best: DataFrame) -> DataFrame:
    """The reads with their cluster; reads without one are left out."""
    return reads.join(best.select("read", "cluster"), "read")


def memberships(reads: DataFrame, bins: DataFrame, stats: DataFrame, hash_size: int, least: float = LEAST_RATIO, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """(read, cluster, llr) of all clusters over the limit, by the older rule.

    The total takes all of a read's k-mers with multiplicity, a cluster's part its distinct ones.
    """
    return rated_memberships(read_evidence(reads, bins, True, lookup_bytes), stats, hash_size, least)


def rated_memberships(evidence: DataFrame, stats: DataFrame, hash_size: int, least: float = LEAST_RATIO) -> DataFrame:
    """``memberships`` of what ``read_evidence`` or ``text_evidence`` found by the older rule."""
    usable = stats.where((F.col("size") < MOST_SHARE * (1 << hash_size)) & (F.col("prob") > LEAST_PRIOR))
    rated = evidence.join(usable.select("cluster", "prob"), "cluster")
    rated = rated.withColumn("llr", log_likelihood_ratio(F.col("m"), F.col("s"), F.col("prob")))
    return rated.where(F.col("llr") > least).select("read", "cluster", "llr")


def best_membership(found: DataFrame) -> DataFrame:
    """The membership with the largest (ratio, cluster as text) of each read."""
    best = found.groupBy("read").agg(F.max(F.struct("llr", F.col("cluster").cast("string").alias("name"), "cluster")).alias("b"))
    return best.select("read", F.col("b.cluster").alias("cluster"), F.col("b.llr").alias("llr"))


def spike_report(rows: DataFrame, spiked: Column, top: int = 5) -> DataFrame:
    """(cluster, spiked, total, pct): the clusters with the most spiked reads; pct is cut to an integer."""
    sums = rows.groupBy("cluster").agg(F.count_if(spiked).alias("spiked"), F.count("*").alias("total"))
    return sums.withColumn("pct", F.floor(F.col("spiked") * 100 / F.col("total")).cast("long")).orderBy(F.desc("spiked"), "cluster").limit(top)
