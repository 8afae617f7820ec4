import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import planted


def longest(a, b):
    """The longest common stretch."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = before[j] + 1
                best = max(best, row[j + 1])
        before = row
    return best


@pytest.mark.parametrize("k,stretch", [(5, 12), (4, 4), (3, 9)])
def test_planted_sequences_are_those_of_all_pairs(spark, k, stretch):
    rng = random.Random(k)
    dna = lambda n: "".join(rng.choice("ACGTé\U0001F600") for _ in range(n))
    spikes = [(i, dna(rng.randint(3, 40))) for i in range(8)] + [(8, None), (9, ""), (None, dna(30))]
    reads = []
    for i in range(60):
        text = dna(rng.randint(0, 40))
        if i % 2:
            spike = spikes[rng.randrange(8)][1]
            at, n = rng.randrange(len(spike)), rng.randint(1, 20)
            text += spike[at : at + n] + dna(5)
        reads.append((i, text))
    reads += [(100, None), (101, spikes[0][1] * 3), (101, spikes[0][1] * 3)]
    got = planted.planted(spark.createDataFrame(reads, "doc_id long, text string"), "doc_id", spark.createDataFrame(spikes, "item_id long, text string"), "item_id", k=k, stretch=stretch)
    want = {(r, s) for r, x in reads for s, y in spikes if s is not None and x and y and longest(x, y) >= stretch}
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    texts, given = dict(reads), dict(spikes)
    for r in rows:
        whole = longest(texts[r["doc_id"]], given[r["item_id"]])
        assert stretch <= r["longest"] <= whole
        assert r["longest"] == whole or whole > stretch + k


def test_every_window_has_its_minimiser():
    codes = np.random.default_rng(1).integers(0, 4, 70_000).astype(np.uint32)
    places = planted.minimisers(codes, 6, 10)
    n = len(codes) - 5 - 10 + 1
    nearest = places[np.searchsorted(places, np.arange(n))]
    assert (nearest < np.arange(n) + 10).all() and len(places) < 0.3 * len(codes)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "A" * 80)], "item_id long, text string")
    assert planted.planted(none, "doc_id", some, "item_id").count() == 0
    assert planted.planted(some, "item_id", none, "doc_id").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text_have_the_seeds_of_the_whole(monkeypatch, piece):
    monkeypatch.setattr(planted, "PIECE", piece)
    rng = random.Random(piece)
    for text in ["".join(rng.choice("ACé\U0001F600") for _ in range(n)) for n in (0, 11, 12, 13, 70, 500)] + ["A" * 90, "AC" * 60]:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        want = planted.minimisers(codes, 5, 8)
        parts = list(planted._seeds_of(text, 5, 12))
        assert [p for places, _ in parts for p in places.tolist()] == want.tolist()
        assert [s for _, found in parts for s in found.tolist()] == planted._hashes(codes, 5)[want].astype(np.int64).tolist()


def test_batches_to_workers_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    try:
        texts = spark.range(24).select("id", F.expr("repeat(concat('text', id), 200000)").alias("text")).coalesce(1)
        planted.planted(texts, "id", spark.createDataFrame([(1, "A" * 80)], "item_id long, text string"), "item_id")
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) <= planted.BATCH_BYTES + 2_000_000 and sum(r["n"] for r in sizes) > 20_000_000
        spark.conf.set(name, "1000")
        planted.bound_batches(spark)
        assert spark.conf.get(name).removesuffix("b") == "1000"
    finally:
        spark.conf.set(name, before)
