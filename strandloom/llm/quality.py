"""Document quality by Bradley-Terry ranking.

A document's score is linear in features of its text. It is learned from preference pairs (a document
marked good, one marked bad) with the logistic loss on the difference of their features; a threshold is then
set at a quantile of the scores.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, logistic, sampled_labels
from .runtime import arrow_map
from .textkit import Words, text_slices

#: Bound of the labelled sample (documents) and number of preference pairs drawn from it.
SAMPLE_ROWS = 8000
PAIRS = 40_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "non_ascii", "distinct_words", "commonest_word", "repeated_next",
    "distinct_pairs", "short_words", "no_letter_words", "line_words", "repeated_lines", "ends_in_symbol", "space",
)
BINS = 6

_kind = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 space, 6 beyond ASCII
_kind[0x21:0x7F] = 4
_kind[0x61:0x7B], _kind[0x41:0x5B], _kind[0x30:0x3A], _kind[0x80:] = 1, 2, 3, 6
_kind[[0x20, 9, 10, 11, 12, 13]] = 5
#: Signs of ordinary prose, which are no symbols here.
_kind[[ord(c) for c in ".,;:'\"?-()"]] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of whole texts; zeros for an empty one."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    words = Words(data, offsets)
    kinds = _kind[data]
    size = np.maximum(np.diff(offsets), 1)

    def per_row(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[offsets[1:]] - run[offsets[:-1]]) / size

    for name, mask in (("upper", kinds == 2), ("digits", kinds == 3), ("symbols", kinds == 4), ("non_ascii", kinds == 6), ("space", kinds == 5)):
        out[:, FEATURES.index(name)] = per_row(mask)
    length = words.end - words.start
    letters = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == 2) | (kinds == 6))])
    bare = letters[words.end] == letters[words.start]
    tail = kinds[words.end - 1] == 4
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    for i in range(rows):
        lo, hi = words.bounds[i], words.bounds[i + 1]
        n = hi - lo
        if not n:
            continue
        h, size_i = words.hash[lo:hi], length[lo:hi]
        ordered = np.sort(h)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        pairs = h[1:] ^ (h[:-1] * np.uint64(3))
        line = newline[words.start[lo:hi]]
        cuts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        lines = np.add.reduceat(h, cuts)
        out[i, [0, 1, 6, 7, 8, 9, 10, 11, 12, 13, 14]] = (
            np.log1p(n), size_i.mean(), (len(edges) - 1) / n, np.diff(edges).max() / n, (h[1:] == h[:-1]).mean() if n > 1 else 0,
            len(np.unique(pairs)) / (n - 1) if n > 1 else 1, (size_i <= 3).mean(), bare[lo:hi].mean(), np.log1p(n / len(cuts)),
            1 - len(np.unique(lines)) / len(cuts), tail[lo:hi].mean(),
        )
    return out


@dataclasses.dataclass
class Ranker:
    edges: np.ndarray  # (FEATURES, BINS - 1): quantiles between which a feature's part of the score is constant
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0  # the score quantile at which documents are told apart
    slope: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and, for shape, the bin of each."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        steps = [(x[:, [j]] > self.edges[j]).astype(float) for j in range(x.shape[1])]
        return np.concatenate([z, *steps], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and THRESHOLD exactly at the cut."""
        z = (self.score(x) - self.cut) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> Ranker:
    """Learn from all features x and marks y (1 good); without both classes every document scores alike."""
    n = x.shape[1] if x.ndim == 2 else len(FEATURES)
    blank = Ranker(np.zeros((n, BINS - 1)), np.zeros(n), np.ones(n), np.zeros(n * BINS))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return blank
    rng = np.random.default_rng(seed)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    model = Ranker(edges, x.mean(0), np.maximum(x.std(0), 1e-9), np.zeros(n * BINS))
    wide = model.expand(x)
    test = rng.random(len(y)) < 0.2
    if not (len(good[~test[good]]) and len(bad[~test[bad]]) and len(good[test[good]]) and len(bad[test[bad]])):
        test = np.ones(len(y), dtype=bool)
        train_good, train_bad = good, bad
    else:
        train_good, train_bad = good[~test[good]], bad[~test[bad]]
    a, b = rng.choice(train_good, pairs), rng.choice(train_bad, pairs)
    # each pair once in either direction, so that the loss needs no constant
    flip = rng.random(pairs) < 0.5
    diff = np.where(flip[:, None], wide[b] - wide[a], wide[a] - wide[b])
    model.weights = logistic(diff, (~flip).astype(float), l2=1e-4)
    s = wide @ model.weights
    # the quantile of scores on rows not trained on where the two classes are told apart best
    grid = np.unique(np.quantile(s[test], np.linspace(0.005, 0.995, 199)))
    hit = [((s[test & (y == 1)] >= c).mean() + (s[test & (y == 0)] < c).mean(), c) for c in grid]
    best = max(h for h, _ in hit)
    model.cut = float(np.mean([c for h, c in hit if h >= best - 1e-9]))
    line = np.stack([s[test] - model.cut, np.ones(test.sum())], axis=1)
    model.slope = float(np.clip(logistic(line, y[test].astype(float), l2=1e-3)[0], 0.05, 50))
    return model


def _feature_frame(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = docs.select("text", *keep)
    fields = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[1:])

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            x = features(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], flat], names=[*keep, "x"])

    return arrow_map(rows, kernel, f"{fields}x array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, rows: int = SAMPLE_ROWS, seed: int = 7) -> Ranker:
    """Learn from about ``rows`` labelled documents outside the held-out fold; only their features reach the driver."""
    marks = sampled_labels(labels, "quality", fold(F.col("doc_id"), folds) != held_out_fold, rows, seed)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    got = _feature_frame(sample, ("doc_id", "y")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got]))


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, score (0 to 1), rank_score of every text; null is empty, and an empty text has zero features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array(shared.value.probability(x)), pa.array(shared.value.score(x))],
                names=["doc_id", "score", "rank_score"],
            )

    return arrow_map(docs.select("text", "doc_id"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, rank_score double")


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= THRESHOLD), rank_score. A null id is held out.

    Nulls, empty and long texts, repeated rows and an empty table as in ``scored``; a label of a document that isn't there
    teaches nothing, and equal texts score alike.
    """
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out_fold, F.lit(True))
    return scored(docs, train(docs, labels, folds, held_out_fold)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "rank_score"
    )
