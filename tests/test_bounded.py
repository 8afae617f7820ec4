"""What a kernel holds doesn't grow with a batch: kernels run here on one large batch, in this process."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from strandloom.functions import kmer
from strandloom.operators import hyperplane, partition, planted

from .test_prepared import K, planes


class Frame:
    """As much of a DataFrame as a kernel's maker asks for; mapInArrow gives the kernel itself."""

    isStreaming = True

    def __init__(self, **kinds):
        self.columns, self.dtypes = list(kinds), list(kinds.items())
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=1, broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def texts(rows=1500, size=2000):
    rng = np.random.default_rng(1)
    return [rng.choice(list(b"ACGT"), size).astype(np.uint8).tobytes().decode() for _ in range(rows)]


def peak(run, batch):
    """(MB held at most, batches out): each batch is let go at once, as Spark does."""
    tracemalloc.start()
    n = sum(1 for _ in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, n


def test_a_batch_of_reads_is_hashed_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(texts())], names=["seq"])
    most, n = peak(hyperplane.hash_reads(Frame(seq="string"), planes(), K, strands=True), batch)
    assert most < 100 and n > 10


def test_slices_are_the_whole_batch_in_order():
    seqs = ["A" * n for n in (3, 0, 9, 2, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs)], names=["seq"])
    parts = list(hyperplane.read_slices(batch, 0, 5))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).column(0).to_pylist() == seqs


def test_a_batch_of_texts_is_counted_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{i % 3}" for i in range(1500)]), pa.array(texts())], names=["key", "text"])
    most, _ = peak(kmer.partial_counts(Frame(key="string", text="string"), "key", "text", 12, 20), batch)
    assert most < 100


@pytest.mark.parametrize("counters,held,windows", [(24 << 20, 1000, 1 << 31), (2 << 10, 40, 1 << 31), (0, 40, 1 << 31), (3 << 10, 40, 900)])
def test_counts_in_counters_and_beyond(monkeypatch, counters, held, windows):
    """Keys with counters, keys without, and counters handed on before they overflow."""
    monkeypatch.setattr(kmer, "COUNTERS", counters)
    monkeypatch.setattr(kmer, "HELD_BINS", held)
    monkeypatch.setattr(kmer, "MOST_WINDOWS", windows)
    keys, rows = ["b", None, "a", "c", "b"] * 4, [*texts(16, 60), None, "", "AC", "\u00e9\U0001F600" * 9]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 6]), pa.array(rows[i : i + 6])], names=["key", "text"]) for i in range(0, 20, 6)]
    want, got, n = Counter(), Counter(), 0
    for key, text in zip(keys, rows):
        for i in range(len(text or "") - 4):
            want[key, sum(ord(c) * x for c, x in zip(text[i : i + 5], kmer.coefficients(5, 10))) % 1024] += 1
    for out in kmer.partial_counts(Frame(key="string", text="string"), "key", "text", 5, 10)(iter(batches)):
        n += out.num_rows
        for row in out.to_pylist():
            got[row["key"], row["bin"]] += row["cnt"]
    assert got == want and (counters < 24 << 20 or n == len(want))


@pytest.mark.parametrize("lookup", [True, False])
def test_evidence_of_a_batch_of_texts_is_made_in_slices(lookup):
    rng = np.random.default_rng(2)
    table = np.arange(1 << 12), rng.random(1 << 12), np.arange((1 << 12) + 1), rng.integers(0, 20, 1 << 12).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts())], names=["read", "text"])
    frame, slices = Frame(read="long", text="string"), partition._text_slices(12, 12)
    run = partition._evidence_by_lookup(frame, "text", slices, table, True) if lookup else partition._kmers_of(frame, "text", slices)
    most, n = peak(run, batch)
    assert most < 60 and n > 10


@pytest.mark.parametrize("places,sums", [(16 << 20, 1 << 22), (0, 0)])
@pytest.mark.parametrize("distinct", [False, True])
def test_sums_by_place_and_by_search(monkeypatch, places, sums, distinct):
    """Bins that a table lacks on either side of it, and clusters that aren't numbered from 0."""
    monkeypatch.setattr(partition, "PLACES", places)
    monkeypatch.setattr(partition, "DENSE_SUMS", sums)
    table = np.array([3, 5, 9]), np.array([1.0, 2.0, 4.0]), np.array([0, 2, 2, 3]), np.array([7, 40, 40], dtype=np.int32)
    row, bins = np.array([0, 0, 0, 0, 2, 2, 2, 3]), np.array([3, 3, 9, 10, -1, 5, 9, 4])
    got = partition._sums(row, bins, 5, table, distinct, partition._places(table[0]))
    found = sorted(zip(*(x.tolist() for x in got)))
    assert found == ([(0, 7, 6.0, 1.0), (0, 40, 6.0, 5.0), (2, 40, 6.0, 4.0)] if distinct else [(0, 7, 6.0, 2.0), (0, 40, 6.0, 6.0), (2, 40, 4.0, 4.0)])


@pytest.mark.parametrize("k", [3, 8, 9])
def test_kmers_are_added_up_over_slices(monkeypatch, k):
    """Copies of a text in many slices and batches are one row each, unless their characters are wide."""
    monkeypatch.setattr(kmer, "SLICE_CHARS", 64)
    rows = [*texts(2, 40) * 20, None, "", "AC", "\u00e9\U0001F600" * 9, "\u00ff" * 20]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 9], pa.string())], names=["text"]) for i in range(0, len(rows), 9)]
    want = Counter(t[i : i + k] for t in rows if t for i in range(len(t) - k + 1))
    got, n = Counter(), 0
    for out in kmer.text_kmers(Frame(text="string"), "text", k, 10)(iter(batches)):
        n += out.num_rows
        for row in out.to_pylist():
            got[row["kmer"]] += row["n"]
            assert row["bin"] == sum(ord(c) * x for c, x in zip(row["kmer"], kmer.coefficients(k, 10))) % 1024
    assert got == want and (k > 8 or n == len(want))


def test_seeds_of_a_batch_of_texts_are_made_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts())], names=["key", "text"])
    most, n = peak(planted.seeds(Frame(key="long", text="string"), "key", "text", 15, 50), batch)
    assert most < 15 and n > 10


@pytest.mark.parametrize("text", [texts(1, 3_000_000)[0], "A" * 300_000], ids=["long", "one character"])
def test_seeds_of_one_text_are_made_in_pieces(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["key", "text"])
    most, n = peak(planted.seeds(Frame(key="long", text="string"), "key", "text", 15, 50), batch)
    assert most < 25 and n > 5
