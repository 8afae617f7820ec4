import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import kmer
from strandloom.functions.vectors import log_likelihood_ratio
from strandloom.operators import abundance, cluster, hyperplane, pairs, partition, reports, spectral

DNA = st.text("ACGT", min_size=5, max_size=40)


def planes(k=5, size=6, seed=2):
    rng = np.random.default_rng(seed)
    sample = np.array([hyperplane.coordinates("".join(rng.choice(list("ACGT"), k))) for _ in range(60)])
    return hyperplane.make_wheels(sample, k, size, wheels=2, seed=seed)


def test_plane_goes_through_its_points():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4, 4)) + 1j * rng.normal(size=(4, 4))
    p, c = hyperplane.plane_through(points)
    null = np.concatenate([p, [c]]).conj()
    assert np.allclose(np.concatenate([points, -np.ones((4, 1))], axis=1) @ null, 0, atol=1e-9)


def quality(seq):
    """Qualities that differ from place to place keep k-mers off the planes, which go through k-mers without any."""
    return "".join(chr(35 + (7 * i * i + 3 * i) % 37) for i in range(len(seq)))


@settings(max_examples=40, deadline=None)
@given(DNA)
def test_strands_share_their_bins_unless_the_bins_tie(seq):
    wheels = planes()
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a = hyperplane.kmer_bins(hyperplane.coordinates(seq, quality(seq)), wheels, 5)
    b = hyperplane.kmer_bins(hyperplane.coordinates(back, quality(seq)[::-1]), wheels, 5)[::-1]
    assert (a == b).all()  # 2**6 bins: no two differ by a million


@settings(max_examples=30, deadline=None)
@given(DNA)
def test_bins_against_a_plain_loop(seq):
    wheels, k = planes(), 5
    coords = hyperplane.coordinates(seq, quality(seq))
    got = hyperplane.kmer_bins(coords, wheels, k, both_strands=False)
    for i in range(len(seq) - k + 1):
        for w in (0, 1):
            want = sum(1 << s for ww, s, pr, pi, cr, _ in wheels if ww == w and sum((x * complex(a, -b)).real for x, a, b in zip(coords[i : i + k], pr, pi)) > cr)
            assert got[i, w] == want


def test_quality_scales_coordinates():
    assert np.allclose(hyperplane.coordinates("ATCGN", "+++++"), np.array([-1, 1, -1j, 1j, 0]) * 0.9)
    assert hyperplane.kmer_bins(hyperplane.coordinates("ACG"), planes(), 5).shape == (0, 2)


def test_window_bins_stay_inside_rows():
    codes = np.array([ord(c) for c in "abcdeXYZ"], dtype=np.uint32)
    row, bins = kmer.window_bins(codes, np.array([0, 5, 8]), 3, 12)
    c = kmer.coefficients(3, 12)
    assert row.tolist() == [0, 0, 0, 1]
    assert bins.tolist() == [sum(ord(x) * y for x, y in zip(t, c)) % 4096 for t in ("abc", "bcd", "cde", "XYZ")]


def test_bin_counts_of_null_empty_and_short_texts(spark):
    rows = spark.createDataFrame([("a", "abcd"), ("a", "abc"), (None, "abc"), ("b", None), ("b", ""), ("b", "ab")], "k string, t string")
    got = {(r["k"], r["cnt"]) for r in kmer.bin_counts(rows, "k", "t", 3, 20).collect()}
    assert got == {("a", 2), ("a", 1), (None, 1)}


def test_saturation_is_the_same_for_partial_counts(spark):
    rows = spark.createDataFrame([("s", 1, 40000), ("s", 1, 40000), ("s", 2, 5)], "sample string, bin long, cnt long")
    assert {(r["bin"], r["cnt"]) for r in abundance.saturated(rows).collect()} == {(1, 65535), (2, 5)}


def test_idf_falls_with_document_frequency(spark):
    rows = spark.createDataFrame([(s, b, 1) for s in "abc" for b in range(ord(s) - 96)], "sample string, bin long, cnt long")
    w = {r["bin"]: (r["df"], r["gw"]) for r in abundance.idf_weights(rows).collect()}
    assert w == {0: (3, np.log2(5 / 4)), 1: (2, np.log2(5 / 3)), 2: (1, np.log2(5 / 2))}


def test_gram_and_projection_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.random((5, 30)) * (rng.random((5, 30)) < 0.4)
    rows = spark.createDataFrame([(f"s{i}", j, float(m[i, j])) for i in range(5) for j in range(30) if m[i, j]], "sample string, bin long, x double")
    names, u, s = spectral.eigenspace(spectral.gram(rows), rank=4)
    assert np.allclose(s, np.linalg.svd(m)[1][:4])
    got = {r["bin"]: r["vec"] for r in spectral.projected(rows, names, u).collect()}
    assert all(np.allclose(v, u.T @ m[:, j]) for j, v in got.items())


def test_leaders_join_lead_and_collapse():
    c = cluster.Leaders(0.9)
    c.merge(np.array([[1.0, 0], [0.99, 0.05], [0, 1.0], [0.98, 0.1], [0, 0]]))
    assert c.counts.tolist() == [3, 1]
    other = cluster.Leaders(0.9999)
    other.merge(np.array([[0.999, 0.03]] * 3))
    c._lead(other.centroids[0], 3)
    c.collapse()  # a tie removes the later one
    assert c.counts.tolist() == [3, 1]
    c.merge(other.centroids, other.counts.astype(float))
    assert c.counts.tolist() == [6, 1]


def one_by_one(vectors, reach):
    """The rule for one chunk, vector by vector."""
    leaders, queued = [], []
    unit = lambda v: v / np.linalg.norm(v)
    for v in vectors:
        dist = [1 - unit(v) @ unit(c) for c in leaders]
        if dist and min(dist) < reach:
            queued[int(np.argmin(dist))].append(v)
        else:
            leaders.append(v)
            queued.append([])
    return [(c + sum(q)) / (1 + len(q)) if q else c for c, q in zip(leaders, queued)], [1 + len(q) for q in queued]


def test_a_chunk_is_merged_as_vector_by_vector():
    v = np.random.default_rng(2).normal(size=(300, 4))
    c = cluster.Leaders(0.7)
    c.merge(v)
    means, counts = one_by_one(v, c.reach)
    assert c.counts.tolist() == counts and np.allclose(c.centroids, means)


def test_likelihood_ratio_limits_and_ties(spark):
    rows = spark.createDataFrame([(10.0, 9.0, 0.1), (10.0, 0.5, 0.1), (0.0, 0.0, 0.1)], "m double, s double, b double")
    got = [r[0] for r in rows.select(log_likelihood_ratio(F.col("m"), F.col("s"), F.col("b"))).collect()]
    v1, v2 = 10 * 0.8 * 0.2, 10 * 0.1 * 0.9
    assert got[1] is None and got[2] is None
    assert abs(got[0] - (np.log(np.sqrt(v2) / np.sqrt(v1)) + 0.5 * ((9 - 1) ** 2 / v2 - (9 - 8) ** 2 / v1))) < 1e-12
    evidence = spark.createDataFrame([("r", 1, 10.0, 9.0), ("r", 2, 10.0, 9.0)], "read string, cluster int, m double, s double")
    stats = spark.createDataFrame([(1, 0.1), (2, 0.1)], "cluster int, prob double")
    assert partition.best_cluster(evidence, stats).first()["cluster"] == 2


def test_evidence_counts_multiplicity_and_clustered_kmers_only(spark):
    kmers = spark.createDataFrame([("r", 1, 2), ("r", 2, 1), ("r", 3, 9)], "read string, bin long, n long")
    members = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "bin long, cluster int")
    weights = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "bin long, gw double")
    got = {(r["cluster"], r["m"], r["s"]) for r in partition.evidence_by_join(kmers, partition.bin_table(members, weights)).collect()}
    assert got == {(0, 7.0, 4.0), (1, 7.0, 7.0)}


def test_trimming_at_the_third_bad_base(spark):
    rows = spark.createDataFrame([("IIII",), ('II""""II',), ('""II"I"I"I',), ("",)], "q string")
    assert [r[0] for r in rows.select(kmer.trimmed_length(F.col("q"), 3)).collect()] == [4, 5, 9, 0]


def test_ids_and_mates(spark):
    row = spark.createDataFrame([("@r1 1:N:0", "@r1/2 x", "@lone y")], "a string, b string, c string").select(
        kmer.read_base_id(F.col("a"), 1), kmer.mate_id(kmer.read_base_id(F.col("b"), 2)), kmer.pair_key(kmer.read_base_id(F.col("c"), 0))
    )
    assert list(row.first()) == ["@r1 1", "@r1/1", "@lone"]


def test_n50_and_upper_median(spark):
    rows = spark.createDataFrame([("g", x) for x in (10, 10, 5, 3)] + [("h", 7)], "g string, l long")
    assert {r["g"]: (r["n"], r["total"], r["longest"], r["n50"]) for r in reports.n50(rows, "g", "l").collect()} == {"g": (4, 28, 10, 10), "h": (1, 7, 7, 7)}
    assert {r["g"]: r["mid"] for r in reports.spread(rows, "g", "l").collect()} == {"g": 10, "h": 7}


def test_collisions_count_pairs_of_copies(spark):
    rows = spark.createDataFrame([(1, "AAA", 3), (1, "AAT", 2), (2, "CCC", 1)], "bin long, kmer string, n long")
    assert {r["distance"]: r["n_pairs"] for r in pairs.collision_histogram(rows, 3).collect()} == {0: 4, 1: 6}


def test_a_batch_has_the_coordinates_of_its_reads():
    import pyarrow as pa

    seq = ["ACGTN", "", "acgt", None, "TTTTTTT", "AC"]
    qual = ["IIII!", "", None, "II", "IIII", "IIIII"]
    kept, offset = np.array([5, 0, 3, 9, 9, 9]), np.array([33, 33, 33, 33, 64, 33])
    for letter in ("", "é"):
        seqs = [s if s is None else s + letter for s in seq]
        flat, size = hyperplane.batch_coordinates(pa.array(seqs).slice(0), pa.array(qual, pa.string()), kept, offset)
        want = [hyperplane.coordinates((s or "").upper()[:n], None if q is None else q[:n], o) for s, q, n, o in zip(seqs, qual, kept, offset)]
        assert size.tolist() == [len(w) for w in want] and np.allclose(flat, np.concatenate(want))
    flat, size = hyperplane.batch_coordinates(pa.array(["x", "ACG", "TT"]).slice(1), None, None, np.array([33, 33]))
    assert size.tolist() == [3, 2] and np.allclose(flat, np.concatenate([hyperplane.coordinates(x) for x in ("ACG", "TT")]))
