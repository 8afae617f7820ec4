"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart from each other, one on windows of ordinary text and one on windows of
toxic text. Every text is cut into windows of a few words; a window's distance is what its compressed length under
the ordinary dictionary is over that under the toxic one. The largest distances of a document and the counts of its
windows beyond several thresholds are its features, and a logistic calibration on labelled documents that neither
dictionary has seen gives the score.

Labels mark documents, most of whose text is ordinary. So the toxic dictionary is trained on those windows of
toxic documents that hold a run of bytes as long as the trainer's own unit (SEGMENT) that is in several toxic
documents and many times likelier there.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, logistic, sampled_labels, unit_hash
from .runtime import arrow_map, table
from .textkit import ALNUM_WORDS, LOWER, SLICE_BYTES, Words, mix, pieces, text_slices

#: Words of a window.
WINDOW_WORDS = 2
#: Bounds of what training gathers: labelled documents, and windows for each dictionary (both chosen by hash).
SAMPLE_ROWS = 8000
SAMPLE_WINDOWS = 100_000
#: Bytes of a run, and when it counts as toxic: in so many toxic documents and such a share of them, so many times likelier there.
SEGMENT = 6
LEAST_DOCS = 3
LEAST_SHARE = 0.007
LEAST_RATIO = 20.0
SEGMENT_BITS = 22
#: Distances of so many windows are kept by a worker; a window that comes again isn't compressed again.
MEMO = 300_000
STEPS = (2, 3, 4, 5, 6, 8)
ORDINARY_BYTES, TOXIC_BYTES = 1 << 17, 1 << 16
#: Toxic share of documents for which the calibration is made.
PRIOR = 0.3
#: Ends every window and both dictionaries: a sure match, so that a window never falls back to being stored.
_PAD = bytes(range(1, 9)) + bytes(range(14, 30))
_U = np.uint64


@dataclasses.dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the standardised features and a constant


@functools.lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes):
    """A quick and a thorough compressor for each dictionary: (quick ordinary, quick toxic, ordinary, toxic)."""
    made = []
    for strategy, search in ((zstd.STRATEGY_GREEDY, 2), (zstd.STRATEGY_LAZY, 4)):
        how = zstd.ZstdCompressionParameters.from_level(
            3, min_match=4, strategy=strategy, search_log=search, chain_log=17, hash_log=17, window_log=18, write_content_size=False, write_dict_id=False
        )
        for content in (ordinary, toxic):
            known = zstd.ZstdCompressionDict(content + _PAD)
            known.precompute_compress(compression_params=how)
            made.append(zstd.ZstdCompressor(dict_data=known, compression_params=how).compress)
    return made


def _letters(low: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters or digits; spaces and symbols (of Latin-1, general and wide punctuation too) don't."""
    inside = ALNUM_WORDS[low]
    two = np.flatnonzero(low[:-1] == 0xC2)
    two = two[~np.isin(low[two + 1], (0xAA, 0xB5, 0xBA))]
    inside[two] = inside[two + 1] = False
    for lead, least, most in ((0xE2, 0x8080, 0x81AF), (0xE3, 0x8080, 0x8084), (0xE3, 0x8088, 0x809F), (0xEF, 0xBC81, 0xBC8F)):
        at = np.flatnonzero(low[:-2] == lead)
        after = low[at + 1].astype(np.int32) << 8 | low[at + 2]
        at = at[(after >= least) & (after <= most)]
        inside[at] = inside[at + 1] = inside[at + 2] = False
    return inside


class Plain:
    """Lower-cased words (runs of letters and digits) of a slice's rows with one space before, between and after them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        low[~_letters(low)] = 0x20
        words = Words(low, offsets)
        size = words.end - words.start
        n_words = np.diff(words.bounds)
        self.bounds, self.hash = words.bounds, words.hash
        self.row = np.repeat(np.arange(len(n_words)), n_words)
        upto = np.cumsum(size) - size
        self.start = upto + np.arange(len(size)) + self.row + 1
        self.end = self.start + size
        self.bytes = np.full(int(size.sum()) + len(size) + len(n_words), 0x20, dtype=np.uint8)
        run = np.arange(int(size.sum()))
        self.bytes[run + np.repeat(self.start - upto, size)] = low[run + np.repeat(words.start - upto, size)]

    def windows(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, row) of windows of WINDOW_WORDS that begin at every step-th word of a row."""
        n_words = np.diff(self.bounds)
        per_row = -(-np.maximum(n_words - (WINDOW_WORDS - step), n_words > 0) // step)
        ends = np.cumsum(per_row)
        row = np.repeat(np.arange(len(per_row)), per_row)
        first = self.bounds[:-1][row] + step * (np.arange(len(row)) - (ends - per_row)[row])
        return first, np.minimum(first + WINDOW_WORDS, self.bounds[1:][row]) - 1, row

    def distinct(self, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Distinct windows as bytes, and the number of each window among them."""
        key = self.hash[first]
        for j in range(1, WINDOW_WORDS):
            more = first + j <= last
            key[more] = mix(key[more]) + self.hash[first[more] + j]
        _, at, which = np.unique(key, return_index=True, return_inverse=True)
        blob = self.bytes.tobytes()
        return [blob[s:e] for s, e in zip((self.start[first[at]] - 1).tolist(), (self.end[last[at]] + 1).tolist())], which

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of SEGMENT bytes, by the byte at which it begins; row -1 where it leaves its row."""
        n = max(0, len(self.bytes) - SEGMENT + 1)
        code = np.zeros(n, dtype=np.uint64)
        for i in range(SEGMENT):
            code = (code << _U(8)) | self.bytes[i : i + n]
        n_words = np.diff(self.bounds)
        sizes = np.bincount(self.row, weights=self.end - self.start + 1, minlength=len(n_words)).astype(np.int64) + 1
        row = np.repeat(np.arange(len(n_words)), sizes)
        return np.where(row[:n] == row[SEGMENT - 1 : SEGMENT - 1 + n], row[:n], -1), (mix(code) >> _U(64 - SEGMENT_BITS)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _memo(ordinary: bytes, toxic: bytes) -> dict[bytes, int]:
    return {}


def distances(model: ToxicModel, windows: list[bytes]) -> np.ndarray:
    """Bytes by which each window is shorter under the toxic dictionary than under the ordinary one.

    Where a quick search for matches finds a distance that could count, a thorough one measures it again.
    """
    quick_plain, quick_toxic, plain, toxic = _compressors(model.ordinary, model.toxic)
    memo = _memo(model.ordinary, model.toxic)
    if len(memo) > MEMO:
        memo.clear()
    found = list(map(memo.get, windows))
    fresh = [i for i, known in enumerate(found) if known is None]
    # one dictionary after the other, so that its tables stay in the processor's cache
    padded = [windows[i] + _PAD for i in fresh]
    away = [a - b for a, b in zip([len(quick_plain(w)) for w in padded], [len(quick_toxic(w)) for w in padded])]
    again = [k for k, d in enumerate(away) if d >= STEPS[0]]
    for k, a, b in zip(again, [len(plain(padded[k])) for k in again], [len(toxic(padded[k])) for k in again]):
        away[k] = a - b
    for i, d in zip(fresh, away):
        found[i] = d
        if len(windows[i]) < 40:
            memo[windows[i]] = d
    return np.array(found, dtype=np.int64)


N_FEATURES = 4 + 2 * len(STEPS)


def _sums(model: ToxicModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: number of windows, the three largest distances, counts of windows at or over each step."""
    text = Plain(data, offsets)
    first, last, row = text.windows(1)
    windows, which = text.distinct(first, last)
    dist = distances(model, windows)[which] if len(which) else np.zeros(0, np.int64)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    over = np.stack([np.concatenate([[0], np.cumsum(dist >= s)]) for s in STEPS], axis=1)
    largest = np.full((rows, 3), -np.inf)
    by = np.lexsort((-dist, row))
    for j in range(3):
        has = np.flatnonzero(np.diff(bounds) > j)
        largest[has, j] = dist[by[bounds[has] + j]]
    return np.diff(bounds), largest, over[bounds[1:]] - over[bounds[:-1]]


def features(model: ToxicModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features by row (zeros without words) and the largest distance. A text over SLICE_BYTES is looked through in
    pieces cut at spaces, whose sums are put together."""
    if len(offsets) == 2 and len(data) > SLICE_BYTES:
        parts = [_sums(model, piece, np.array([0, len(piece)])) for piece in pieces(data, SLICE_BYTES)]
        size, over = sum(p[0] for p in parts), sum(p[2] for p in parts)
        largest = -np.sort(-np.concatenate([p[1] for p in parts], axis=1), axis=1)[:, :3]
    else:
        size, largest, over = _sums(model, data, offsets)
    largest = np.where(np.isinf(largest), largest[:, :1], largest)
    largest[size == 0] = 0
    out = np.concatenate(
        [np.log1p(size)[:, None], largest[:, :2], largest.sum(1, keepdims=True), np.log1p(over), over / np.maximum(size, 1)[:, None]], axis=1
    )
    return out, largest[:, 0].astype(np.int64)


def probability(model: ToxicModel, x: np.ndarray) -> np.ndarray:
    wide = np.concatenate([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))], axis=1)
    return 1 / (1 + np.exp(-np.clip(wide @ model.weights, -40, 40)))


def _document_segments(sample: DataFrame) -> DataFrame:
    """(y, h, n): in how many documents of each mark a run of bytes is, added up by batches."""

    def kernel(batch: pa.RecordBatch):
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_slices(batch.column(0)):
            row, code = Plain(data, offsets).segments()
            pairs = np.unique((row[row >= 0] << SEGMENT_BITS) | code[row >= 0])
            marked, n = np.unique((y[a + (pairs >> SEGMENT_BITS)].astype(np.int64) << SEGMENT_BITS) | (pairs & ((1 << SEGMENT_BITS) - 1)), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((marked >> SEGMENT_BITS).astype(np.int32)), pa.array((marked & ((1 << SEGMENT_BITS) - 1)).astype(np.int32)), pa.array(n)], names=["y", "h", "n"]
            )

    return arrow_map(sample.select("text", "y"), kernel, "y int, h int, n long")


def _sample_windows(sample: DataFrame, toxic: np.ndarray | None = None) -> list[bytes]:
    """About SAMPLE_WINDOWS windows, chosen by hash; with ``toxic`` (sorted runs), overlapping windows that hold such a run."""
    shared = sample.sparkSession.sparkContext.broadcast(toxic)

    def kernel(batch: pa.RecordBatch):
        runs = shared.value
        for _, _, data, offsets in text_slices(batch.column(0)):
            text = Plain(data, offsets)
            first, last, _ = text.windows(WINDOW_WORDS if runs is None else 1)
            if runs is not None and len(first):
                row, code = text.segments()
                hit = np.concatenate([[0], np.cumsum((row >= 0) & np.isin(code, runs))])
                begin, stop = text.start[first] - 1, text.end[last] + 1 - SEGMENT + 1
                has = hit[np.minimum(np.maximum(stop, begin), len(hit) - 1)] > hit[np.minimum(begin, len(hit) - 1)]
                first, last = first[has], last[has]
            found, which = text.distinct(first, last)
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in which.tolist()], pa.binary())], names=["window"])

    windows = arrow_map(sample.select("text"), kernel, "window binary").groupBy("window").agg(F.count("*").alias("n"))
    windows = table(windows, "toxic-windows")
    total = windows.agg(F.sum("n")).first()[0] or 0
    got = windows.where(unit_hash(F.col("window"), 3) < min(1.0, SAMPLE_WINDOWS / max(1, total))).collect()
    return [w for w, n in sorted((bytes(r["window"]), r["n"]) for r in got) for _ in range(n)]


def _dictionary(samples: list[bytes], most: int) -> bytes:
    """A trained dictionary of ``most`` bytes or half of the samples' bytes; too few samples are taken as they are."""
    size = min(most, max(4096, sum(map(len, samples)) // 2))
    try:
        return zstd.train_dictionary(size, samples, k=64, d=SEGMENT, steps=1, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, rows: int = SAMPLE_ROWS, seed: int = 9) -> ToxicModel:
    """Learn from about ``rows`` labelled documents outside the held-out fold, two thirds of them for the dictionaries
    and the others for the calibration.

    Equal texts count once. Null and empty texts teach nothing. Without labels of both kinds (an empty table too)
    every text scores PRIOR.
    """
    marks = sampled_labels(labels, "toxic", fold(F.col("doc_id"), folds) != held_out_fold, rows, seed)
    sample = table(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").where(F.length("text") > 0), "toxic-sample")
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    sample = table(sample.withColumn("part", unit_hash(F.col("doc_id"), seed + 1)), "toxic-texts")
    known, other = sample.where("part < 0.66"), sample.where("part >= 0.66")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, o = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    ratio = ((F.col("t") + 0.5) / (sizes.get(1, 0) + 1)) / ((F.col("o") + 0.5) / (sizes.get(0, 0) + 1))
    runs = _document_segments(known).groupBy("h").agg(t.alias("t"), o.alias("o")).where((F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * sizes.get(1, 0))) & (ratio >= LEAST_RATIO))
    toxic = np.array(sorted(r["h"] for r in runs.select("h").collect()), dtype=np.int64)
    model = ToxicModel(
        _dictionary(_sample_windows(known.where("y = 0")), ORDINARY_BYTES), _dictionary(_sample_windows(known.where("y = 1"), toxic), TOXIC_BYTES),
        np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1),
    )
    got = sorted((r["y"], *r["x"]) for r in _feature_frame(other, model, ("y",)).collect())
    y = np.array([g[0] for g in got], dtype=float)
    x = np.array([g[1:] for g in got]).reshape(len(got), N_FEATURES)
    if len(set(y)) < 2:
        model.weights[-1] = np.log(PRIOR / (1 - PRIOR))
        return model
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    wide = np.concatenate([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, PRIOR / y.mean(), (1 - PRIOR) / (1 - y.mean()))
    model.weights = logistic(wide, y, weight, l2=1e-3)
    return model


def _feature_frame(rows: DataFrame, model: ToxicModel, keep: tuple[str, ...]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select("text", *keep)
    fields = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[1:])

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            x, _ = features(shared.value, data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], flat], names=[*keep, "x"])

    return arrow_map(rows, kernel, f"{fields}x array<double>")


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, distance (the largest of any window) of every whole text.

    A null text is empty; a text without words has zero features and the score that goes with them. Repeated rows
    are scored as often as they come, null ids are kept, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0)):
            x, top = features(shared.value, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array(probability(shared.value, x)), pa.array(top)],
                names=["doc_id", "score", "distance"],
            )

    return arrow_map(docs.select("text", "doc_id"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, distance long")


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5), distance. A null id is held out.

    Nulls, empty texts, repeated rows and empty tables as in ``train`` and ``scored``; a label of a document that
    isn't there teaches nothing.
    """
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out_fold, F.lit(True))
    return scored(docs, train(docs, labels, folds, held_out_fold)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "distance"
    )
