"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 3- and 4-grams of lower-cased text in which everything but letters is one boundary sign.
A text is the mean of its subwords' embeddings. Embeddings and softmax are trained together by stochastic
gradient descent; a temperature and a rejection level are then fitted on rows that the descent has not seen.
As the softmax is linear, embedding and softmax are multiplied once and scoring adds up one table row for
each subword.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import fold, unit_hash
from .runtime import arrow_map, marked
from .textkit import LOWER, text_slices

BUCKETS = 1 << 16
DIM = 16
#: Bound of the training sample: windows (one for each sampled document) and code points of a window.
SAMPLE_ROWS = 6000
WINDOW = 600
#: A text of more bytes is looked through in pieces of so many.
LONG_TEXT = 1 << 20
EPOCHS = 6
#: Steps of descent at least: small samples are gone through more often.
LEAST_STEPS = 600
RATE = 0.4
#: Weights stay within this bound, on samples too small for the rate too.
BOUND = 50.0
#: Share of known-language rows that the rejection level may refuse, and a bound of the level.
REFUSED = 0.001
MOST_LEVEL = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords that start at each byte, (2, n); BUCKETS where there is none. And their count by row."""
    low = LOWER[data]
    n = len(low)
    if n:
        after = np.flatnonzero(low[:-1] == 0xC3) + 1  # accented capitals of Latin-1
        caps = after[(low[after] >= 0x80) & (low[after] <= 0x9E) & (low[after] != 0x97)]
        low[caps] += 0x20
        low[~_LETTER[low]] = 0x20
    wide = np.full(n + 3, 0x20, dtype=np.uint32)
    wide[:n] = low
    three = (wide[:-3] << 16) | (wide[1:-2] << 8) | wide[2:-1]
    four = (three << 8) | wide[3:]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    out = np.empty((2, n), dtype=np.int32)
    for i, (code, size, factor) in enumerate(((three, 3, 0x9E3779B1), (four, 4, 0x85EBCA6B))):
        h = code * np.uint32(factor)
        out[i] = (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)
        out[i][(left < size) | ((wide[:-3] == 0x20) & (wide[1:-2] == 0x20))] = BUCKETS
    have = np.concatenate([[0], np.cumsum((out < BUCKETS).sum(0))])
    return out, have[offsets[1:]] - have[offsets[:-1]]


@dataclasses.dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages): what a subword adds to the logits; the last row is zero
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.langs)))
        if not len(self.langs):
            return out
        if rows == 1 and len(data) > LONG_TEXT:
            return self._long(data)
        parts, count = subwords(data, offsets)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            for part in parts:
                out[full] += np.add.reduceat(self.table[part], offsets[full], axis=0)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Logits of one text, piece by piece; a piece sees three bytes more, for the subwords that begin in it."""
        total, count = np.zeros(len(self.langs)), 0
        for at in range(0, len(data), LONG_TEXT):
            piece = data[at : at + LONG_TEXT + 3]
            parts, _ = subwords(piece, np.array([0, len(piece)]))
            for part in parts:
                total += self.table[part[:LONG_TEXT]].sum(axis=0, dtype=np.float64)
                count += int((part[:LONG_TEXT] < BUCKETS).sum())
        return total[None, :] / max(count, 1) + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its number) and calibrated probability of each row."""
        z = self.logits(data, offsets) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def rejection_level(right: np.ndarray) -> float:
    """Probability that a share REFUSED of rightly told rows stay under, from the probabilities of some of them.

    The tail of their surprise (-log p) is taken as exponential beyond its square root of n largest values, so that
    the level goes on smoothly from the smallest samples, where so small a share is beyond the rows that were seen,
    to the largest, where it is a quantile of them. Without a row there is no level (0).
    """
    n = len(right)
    if not n:
        return 0.0
    surprise = np.sort(-np.log(np.maximum(right, 1e-12)))[::-1]
    k = min(max(int(np.sqrt(n)), int(REFUSED * n)), n - 1)
    edge = surprise[k]
    excess = surprise[:k].mean() - edge if k else surprise[0]
    return float(min(np.exp(-(edge + excess * np.log(max(k, 1) / (REFUSED * n)))), MOST_LEVEL))


def sample_sizes(counts: dict[str, int], rows: int) -> dict[str, float]:
    """Rows to take of each language, about ``rows`` in all: as many of each; what a rare one lacks comes from the others."""
    sizes: dict[str, float] = {}
    left = float(rows)
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        sizes[lang] = min(float(n), left / (len(counts) - i))
        left -= sizes[lang]
    return sizes


def fit(texts: list[str], langs: list[str], seed: int = 11) -> LangModel:
    """Train on windows of text; a fifth of them is kept for the temperature and the rejection level."""
    names = sorted(set(langs))
    if not names:
        return LangModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    feats = [subwords(d, np.array([0, len(d)]))[0].ravel() for d in data]
    feats = [f[f < BUCKETS] for f in feats]
    order = rng.permutation(len(texts))
    order = order[[len(feats[i]) > 0 for i in order]]
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(used):
        held, used = order, order
    n_lang = len(names)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, n_lang))
    bias = np.zeros(n_lang)
    batches = max(1, -(-len(used) // 32))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches)) if len(used) else 0
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        for at in range(0, len(used), 32):
            rate = RATE * (1 - step / max(1, steps))
            step += 1
            batch = used[at : at + 32]
            sizes = np.array([len(feats[i]) for i in batch])
            idx = np.concatenate([feats[i] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[idx], starts, axis=0) / sizes[:, None]
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ out.T / sizes[:, None]
            out -= rate * mean.T @ p
            bias -= rate * 0.1 * p.sum(0)
            rows, inverse = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(rows), DIM))
            spread = np.repeat(np.arange(len(batch)), sizes)
            for d in range(DIM):
                grad[:, d] = np.bincount(inverse, weights=back[spread, d], minlength=len(rows))
            emb[rows] = np.clip(emb[rows] - rate * DIM * grad, -BOUND, BOUND)
            np.clip(out, -BOUND, BOUND, out=out)
    table = np.zeros((BUCKETS + 1, n_lang), dtype=np.float32)
    table[:BUCKETS] = emb @ out
    model = LangModel(names, table, bias)
    if len(held):
        blob = np.concatenate([data[i] for i in held])
        offsets = np.concatenate([[0], np.cumsum([len(data[i]) for i in held])])
        z = model.logits(blob, offsets)
        losses = []
        grid = np.geomspace(0.02, 5, 40)
        for t in grid:
            s = z / t
            s = s - s.max(1, keepdims=True)
            p = s - np.log(np.exp(s).sum(1))[:, None]
            # and one row of no known language, lest a few rows that are all told right end in certainty
            losses.append(-p[np.arange(len(held)), y[held]].sum() - p.mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        pred, conf = model.predict(blob, offsets)
        model.reject_below = rejection_level(conf[pred == y[held]])
    return model


def train(docs: DataFrame, folds: int = 3, held_out_fold: int = 1, rows: int = SAMPLE_ROWS, seed: int = 11) -> LangModel:
    """Train on about ``rows`` windows from documents outside the held-out fold, as many from each language that has them;
    what rare languages lack comes from the others."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & (F.length("text") > 0) & (fold(F.col("doc_id"), folds) != held_out_fold)
    )
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, size in sample_sizes(counts, rows).items():
        share = F.when(F.col("lang") == lang, F.lit(size / counts[lang])).otherwise(share)
    # one window a document, of 20 to WINDOW code points, at a place given by the id
    length = (F.lit(20) + unit_hash(F.col("doc_id"), seed + 1) * (WINDOW - 20)).cast("int")
    place = (unit_hash(F.col("doc_id"), seed + 2) * F.greatest(F.length("text") - length, F.lit(0))).cast("int") + 1
    got = (
        usable.where(unit_hash(F.col("doc_id"), seed) < share)
        .select("doc_id", "lang", F.substring("text", place, length).alias("window")).collect()
    )
    got.sort(key=lambda r: (r["doc_id"], r["window"]))
    return fit([r["window"] for r in got], [r["lang"] for r in got], seed)


def _told(model: LangModel, texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, probability, rejected) of texts, with those marked that have a letter."""
    names = np.array([*model.langs, "und"], dtype=object)
    pred, conf = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    known = known & bool(model.langs)
    if model.langs:
        for a, b, data, offsets in text_slices(texts):
            best, p = model.predict(data, offsets)
            pred[a:b], conf[a:b] = names[np.where(known[a:b], best, len(model.langs))], np.where(known[a:b], p, 0.0)
    return pred, conf, ~known | (conf < model.reject_below)


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected, from the text alone.

    A null text or one without a letter is ``und`` with score 0 and is rejected; so is a text whose
    calibrated probability is under the model's rejection level (it still gets a lang_pred). Without a
    single training row every text is ``und``. Repeated rows are told as often as they come, null ids are kept,
    an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch):
        pred, conf, rejected = _told(shared.value, batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(pred, pa.string()), pa.array(conf), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"]
        )

    rows = docs.select("text", _has_letter().alias("letter"), "doc_id")
    return arrow_map(rows, kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def predictions(docs: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. A null id is held out; all else as in ``identify``.

    A null lang teaches nothing; ties between languages go to the first by name.
    """
    model = train(docs, folds, held_out_fold)
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out_fold, F.lit(True))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """The documents whose language is known with enough confidence, with their own columns (whatever their names).

    Null, empty and letterless texts go, null ids and repeated rows are judged by their text, an empty table gives no
    rows. Only the text goes through Python; the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held_out_fold))
    mark = "_lid_accepted"

    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array(~_told(shared.value, texts, np.ones(len(texts), dtype=bool))[2])

    return marked(docs.where(_has_letter()), "text", mark, kernel, "boolean").where(mark).drop(mark)
