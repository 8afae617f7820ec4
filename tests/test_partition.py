import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import cluster, partition
from strandloom.plans.stored import bucketed, stored


@pytest.fixture(scope="module")
def data(spark):
    """40 reads over 60 bins, of which some have weights only and some are in two clusters; odd reads."""
    rng = np.random.default_rng(7)
    reads = [(f"r{i}", [int(b) for b in rng.integers(0, 70, rng.integers(0, 40))]) for i in range(40)] + [("none", []), ("null", None), ("unknown", [999, 1000])]
    weights = [(b, float(rng.random())) for b in range(60)]
    members = [(b, int(c)) for b in range(50) for c in rng.choice(6, rng.integers(0, 3), replace=False)]
    frames = (
        spark.createDataFrame(reads, "read string, bins array<long>").repartition(3), spark.createDataFrame(weights, "bin long, gw double"), spark.createDataFrame(members, "bin long, cluster int"),
    )
    return reads, dict(weights), members, frames


def plainly(reads, gw, members, distinct):
    of = {}
    for b, c in members:
        of.setdefault(b, []).append(c)
    out = []
    for read, bins in reads:
        bins = bins or []
        m = sum(gw[b] for b in bins if b in gw and (distinct or b in of))
        s = {}
        for b in set(bins) if distinct else bins:
            for c in of.get(b, ()):
                s[c] = s.get(c, 0) + gw[b]
        out += [(read, c, round(m, 9), round(x, 9)) for c, x in s.items()]
    return sorted(out)


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("slice_bins", [1 << 20, 5])
def test_evidence_by_lookup_by_join_and_plainly(data, monkeypatch, distinct, slice_bins):
    reads, gw, members, (frame, weights, given) = data
    monkeypatch.setattr(partition, "SLICE_BINS", slice_bins)
    table = stored(partition.bin_table(given, weights), "bins")
    got = lambda df: sorted((r["read"], r["cluster"], round(r["m"], 9), round(r["s"], 9)) for r in df.collect())
    want = plainly(reads, gw, members, distinct)
    assert got(partition.read_evidence(frame, table, distinct)) == want
    assert got(partition.read_evidence(frame, table, distinct, lookup_bytes=0)) == want
    assert got(partition.read_evidence(frame, table.where("false"), distinct)) == []
    assert got(partition.read_evidence(frame.where("false"), table, distinct, lookup_bytes=0)) == []


def test_priors_from_the_table_are_those_of_the_join(data):
    _, _, _, (_, weights, given) = data
    got = lambda df: sorted((r["cluster"], r["size"], round(r["prob"], 12)) for r in df.collect())
    assert got(partition.table_priors(partition.bin_table(given, weights), 9, 10)) == got(cluster.cluster_priors(given, weights, 9, 10))


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_a_bucketed_table_is_met_without_an_exchange_of_its_own(spark, data):
    _, _, _, (frame, weights, given) = data
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        table = bucketed(partition.bin_table(given, weights), "bins", "bin", 4)
        joined = partition.read_kmers(frame).join(table, "bin")
        assert len(exchanges(joined)) == 1  # the reads' bins
        assert not exchanges(table.groupBy("bin").count())
        assert len(exchanges(partition.read_evidence(frame, table, lookup_bytes=0))) == 3  # and their sums by read and set, then by read
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_lookup_needs_no_shuffle(spark, data):
    _, _, _, (frame, weights, given) = data
    assert not exchanges(partition.read_evidence(stored(frame, "reads"), stored(partition.bin_table(given, weights), "bins")))


def test_kmers_of_reads_are_counted_where_they_lie(spark):
    frame = spark.createDataFrame([(1, [5, 5, 2]), (2, []), (3, None), (4, [7])], "read long, bins array<long>")
    rows = partition.read_kmers(frame)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2, 1), (1, 5, 2), (4, 7, 1)] and not exchanges(rows.where(F.lit(True)))


def test_what_is_kept_by_bin_is_summed_and_joined_without_an_exchange(spark, sf_dir):
    from strandloom.operators import abundance, spectral
    from strandloom.plans import queries

    counts = queries._counts(spark, sf_dir)
    by_bin = lambda df: [x for x in exchanges(df) if "(bin#" in x]
    assert by_bin(abundance.saturated_by_bin(queries._partial(spark, sf_dir), 4)) and not by_bin(abundance.idf_weights(counts))
    rows = abundance.conditioned(counts, abundance.idf_weights(counts), queries.BITS)
    assert not by_bin(rows)
    assert not by_bin(spectral._by_bin(bucketed(rows, "conditioned", "bin", dealt=True), spectral.sample_names(rows)))
    assert counts.count() == queries._bin_counts(spark, sf_dir).count()
