import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import numbering, spectral, svd


def sparse(samples, bins, rank, share, seed=1):
    """A noisy matrix of a rank, with most entries left out."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(samples, rank)) * np.geomspace(10, 1, rank) @ rng.normal(size=(rank, bins)) + 0.1 * rng.normal(size=(samples, bins))
    return np.where(rng.random((samples, bins)) < share, a, 0)


def entries(spark, a):
    i, b = np.nonzero(a)
    rows = [(f"s{x:05d}", int(y), float(a[x, y])) for x, y in zip(i, b)]
    return spark.createDataFrame(rows, "sample string, bin long, x double").repartition(5)


@pytest.mark.parametrize("sent,pack", [(64 << 20, 1 << 16), (8 * 130 * 3, 50)])
def test_leading_values_and_vectors_are_those_of_numpy(spark, monkeypatch, sent, pack):
    """Also when the basis is sent in groups of three columns, and packs have a few bins."""
    monkeypatch.setattr(svd, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(svd, "PACK_ENTRIES", pack)
    monkeypatch.setattr(svd, "BLOCK_ROWS", 32)
    monkeypatch.setattr(spectral, "MOST_SAMPLES", 10)  # svd takes what the driver's way refuses
    a = sparse(130, 400, 8, 0.5)
    found = svd.decompose(entries(spark, a), rank=6, tolerance=1e-10)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(found.sigma, s[:6], rtol=1e-6)
    assert found.energy == pytest.approx((s**2).sum())
    got = np.zeros((130, 6))
    for r in found.frame().collect():
        got[int(r["sample"][1:]), r["dim"]] = r["u"]
        assert r["s"] == pytest.approx(s[r["dim"]], rel=1e-6)
    assert np.allclose(np.abs((got * u[:, :6]).sum(0)), 1, atol=1e-5)
    vectors = {r["bin"]: r["vec"] for r in found.projected().collect()}
    assert set(vectors) == set(np.flatnonzero((a != 0).any(0)))
    assert all(np.allclose(v, a[:, b] @ got, atol=1e-8) for b, v in vectors.items())


def test_all_values_add_up_to_the_trace(spark):
    a = sparse(12, 90, 12, 0.5)
    found = svd.decompose(entries(spark, a), rank=12)
    assert np.allclose(found.sigma, np.linalg.svd(a, compute_uv=False), rtol=1e-9)
    assert (found.sigma**2).sum() == pytest.approx(found.energy)


def test_a_matrix_of_small_rank_none_and_zeros(spark):
    a = np.outer(np.arange(1, 41), np.ones(30)) * 1.0
    found = svd.decompose(entries(spark, a), rank=5)
    assert len(found.sigma) == 1 and found.sigma[0] == pytest.approx(np.linalg.norm(a))
    empty = svd.decompose(entries(spark, np.zeros((3, 3))), rank=2)
    assert len(empty.sigma) == 0 and empty.frame().count() == 0 and empty.projected().count() == 0
    zeros = svd.decompose(spark.createDataFrame([("a", 1, 0.0), ("b", 2, 0.0)], "sample string, bin long, x double"))
    assert len(zeros.sigma) == 0


def test_more_samples_than_the_driver_solves(spark):
    """5000 samples, one leading direction planted; the Gram matrix of so many is refused."""
    rows = spark.range(5000).select(F.format_string("s%d", "id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"), "id")
    rows = rows.select("sample", F.when(F.col("j") < 3, F.col("j")).otherwise(F.pmod(F.xxhash64("id", "j"), F.lit(300)) + 3).cast("long").alias("bin"), F.lit(1.0).alias("x"))
    rows = rows.groupBy("sample", "bin").agg(F.sum("x").alias("x"))
    with pytest.raises(ValueError):
        spectral.sample_names(rows)
    found = svd.decompose(rows, rank=1, rounds=8)
    dense = np.zeros((5000, 303))
    for r in rows.collect():
        dense[int(r["sample"][1:]), r["bin"]] = r["x"]
    assert found.sigma[0] == pytest.approx(np.linalg.svd(dense, compute_uv=False)[0], rel=1e-9)


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"))
    got = sorted((r["pos"], r["v"]) for r in numbering.numbered(rows, [F.asc("v")]).collect())
    assert [p for p, _ in got] == list(range(1000)) and [v for _, v in got] == sorted(v for _, v in got)
