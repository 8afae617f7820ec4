"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from strandloom.llm import langid, ngram, toxicity


def buffers(texts):
    blobs = [t.encode() for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])


@pytest.mark.parametrize("form", ["{}!!!", '"{}",', "({})", "[{}]...", "“{}”", "other-{}", "x_{}", "{}/and"])
def test_a_toxic_word_counts_with_symbols_around_it(form):
    known = [f"{a}{b}{c}nov" for a in ("gra", "blu", "zik") for b in ("mpo", "dre", "tul") for c in ("ska", "wif")]
    plain = b" ".join(f"word{i} plain{i}".encode() for i in range(200))
    k = toxicity.N_FEATURES
    model = toxicity.ToxicModel(plain + b" ", " ".join(known).encode() + b" ", np.zeros(k), np.ones(k), np.zeros(k + 1))
    bare, dressed = (toxicity.features(model, *buffers([f"word1 {f.format(w)} plain7" for w in known]))[0] for f in ("{}", form))
    assert (bare[:, 1] >= 4).all() and (dressed[:, 1] >= 4).all()
    steps = slice(4, 4 + len(toxicity.STEPS))
    assert (dressed[:, steps.start] > 0).all()


def test_windows_are_whole_words_without_symbols():
    texts = ["(Ab-c1) «d» e…f ***", "", "x", "naïve’s ªº"]
    plain = toxicity.Plain(*buffers(texts))
    for step, want in ((2, [[" ab c1 ", " d e ", " f "], [], [" x "], [" naïve s ", " ªº "]]), (1, [[" ab c1 ", " c1 d ", " d e ", " e f "], [], [" x "], [" naïve s ", " s ªº "]])):
        first, last, row = plain.windows(step)
        found, which = plain.distinct(first, last)
        assert [[found[which[k]].decode() for k in np.flatnonzero(row == i)] for i in range(len(texts))] == want
    row, code = plain.segments()
    assert np.bincount(row[row >= 0], minlength=4).tolist() == [len(" ab c1 d e f ") - 5, 0, 0, len(" naïve s ªº ".encode()) - 5]


def test_a_long_text_in_pieces_has_the_features_of_its_windows():
    k = toxicity.N_FEATURES
    model = toxicity.ToxicModel(b" plain words " * 50, b" grampona bludrewif " * 50, np.zeros(k), np.ones(k), np.zeros(k + 1))
    long = " ".join(["plain words"] * 60_000 + ["grampona bludrewif"] + ["plain words"] * 100)
    short = " ".join(["plain words"] * 50 + ["grampona bludrewif"] + ["plain words"] * 50)
    (a,), (b,) = (toxicity.features(model, *buffers([t]))[0] for t in (long, short))
    assert a[1] == b[1] > 4 and np.allclose(a[4 : 4 + len(toxicity.STEPS)], b[4 : 4 + len(toxicity.STEPS)])


def test_rejection_is_on_at_every_sample_size(spark):
    rng = np.random.default_rng(4)
    rows = 1 / (1 + np.exp(-rng.normal(4, 1, 2_000_000)))
    want = np.quantile(rows, langid.REFUSED)
    assert langid.rejection_level(rows) == pytest.approx(min(want, langid.MOST_LEVEL), abs=0.01)
    for n in (1, 2, 5, 20, 100, 999, 1000, 5000):
        levels = [langid.rejection_level(rows[i * n : (i + 1) * n]) for i in range(20)]
        assert min(levels) > 0 and np.mean([(rows < x).mean() for x in levels]) < (0.01 if n >= 20 else 1)
    odd = ["xqzt wvkk jjpq zzxw qqkr", "你好世界"]
    for size in ("sf0.001", "sf0.01"):
        model = langid.train(spark.read.parquet(f"/root/testdata/{size}/documents.parquet"))
        assert 1 / len(model.langs) < model.reject_below <= langid.MOST_LEVEL and model.temperature > 0.02
        assert (model.predict(*buffers(odd))[1] < model.reject_below).any()


def test_what_rare_languages_lack_comes_from_the_others():
    counts = {f"r{i}": 5 + i % 15 for i in range(90)} | {f"c{i}": 100_000 for i in range(10)}
    sizes = langid.sample_sizes(counts, 6000)
    assert sum(sizes.values()) == pytest.approx(6000) and all(sizes[x] == counts[x] for x in counts if x[0] == "r")
    assert len({round(sizes[x], 6) for x in counts if x[0] == "c"}) == 1
    assert langid.sample_sizes({"a": 3, "b": 4}, 6000) == {"a": 3, "b": 4} and langid.sample_sizes({}, 6000) == {}


def test_scores_reach_contexts_of_two_words(spark):
    """Only the word before the last one tells what follows."""
    rows = [(i, " ".join(f"{a} then {b}" for a, b in (("red", "stop"), ("green", "go")) for _ in range(3))) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, "red then stop green then go"), (101, "red then go green then go")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram.scored(docs, ngram.train(docs.where("doc_id < 100"))).collect()}
    assert got[100] - got[101] > 1


def test_code_book_spans_all_values_of_a_large_shard():
    rng = np.random.default_rng(2)
    values = np.exp(rng.normal(-3, 0.1, 500_000))
    values[[1, 3]] = 1e-9, 0.9
    book, code = ngram._book(values)
    assert len(book) <= 256 and book[[0, -1]] == pytest.approx([1e-9, 0.9])
    assert np.abs(np.log(book[code]) - np.log(values)).max() <= np.log(0.9 / 1e-9) / 127 / 2 + 1e-9
