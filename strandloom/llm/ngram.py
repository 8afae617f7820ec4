"""Language-model scores from an Elias-Fano n-gram trie.

Words are numbered by their hash; level k of the trie holds, for each (k-1)-gram, the sorted words that followed
it. Pointers (one for each node of the level above, where its range begins) and successors are Elias-Fano
sequences; successors are kept relative to their context (each range starts where the last one ended), so that
one monotone sequence holds them all and a lookup is one pointer and one successor search in its range.
Probabilities and back-off weights (interpolated absolute discounting with three discounts) are quantised to
a byte each; counts are dropped once they have been weighed. A level's shard holds what follows the nodes of the
same shard of the level above; shards are built by executors in the shared folder, and memory-mapped there by
the scoring tasks.

A context that holds more than a thousandth of all tokens is dealt over all shards by the word that follows; every
shard has a pointer for each of those contexts behind its own nodes.
"""

from __future__ import annotations

import dataclasses
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, map_arrays, nested, save_arrays, unnested
from .labelled import fold
from .runtime import arrow_map, bound_batches, local_path, new_path, release_memory
from .textkit import Words, mix, text_slices

ORDER = 3
#: n-grams before they are counted in one task, and tokens for each shard of a level.
FLUSH = 3_000_000
SHARD_TOKENS = 4_000_000
#: Bytes of text looked up at once: every shard is asked once for each such slice.
LOOKUP_BYTES = 4 << 20
#: A context with more tokens than this and than a thousandth of all is dealt over all shards.
HOT_TOKENS = 1 << 20

_U = np.uint64
#: Number of the end of a text among word hashes; it stands before a text's first word too.
END = 0x454E44


@dataclasses.dataclass
class Meta:
    """What a task must know besides the mapped files; of fixed size but for a few numbers a shard."""

    path: str
    tokens: int = 0
    distinct: int = 0
    vocab: list[int] = dataclasses.field(default_factory=list)  # first number of each vocabulary shard, and the end
    bits: int = 1
    bases: dict[int, list[int]] = dataclasses.field(default_factory=dict)  # level -> first node of each shard, and the end
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = dataclasses.field(default_factory=dict)  # level -> hot parents, their totals
    hot_weight: dict[int, np.ndarray] = dataclasses.field(default_factory=dict)
    discounts: dict[int, tuple[float, float, float]] = dataclasses.field(default_factory=dict)


# counting ----------------------------------------------------------------------------------------------------


def _pack(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as differences of as few bytes as the largest needs."""
    gaps = np.diff(keys, prepend=_U(0))
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return width, gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(width: int, blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


_BLOB = pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _counted(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], shard_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Partial counts: blobs of sorted keys and counts, one for each shard and FLUSH keys. A key comes once in a blob."""

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        shard = shard_of(keys)
        by = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[by], counts[by].astype(np.uint32), shard[by]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            width, blob = _pack(keys[a:b])
            yield pa.RecordBatch.from_pydict({"shard": [int(shard[a])], "width": [width], "keys": [blob], "counts": [counts[a:b].tobytes()]}, schema=_BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), LOOKUP_BYTES):
                parts.append(keys_of(data, offsets))
                size += len(parts[-1])
                if size >= FLUSH:
                    yield from emit(parts)
                    parts, size = [], 0
        if size:
            yield from emit(parts)

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "shard int, width int, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """All blobs of a shard: its number, distinct sorted keys, counts."""
    keys = np.concatenate([_unpack(w, k) for w, k in zip(table["width"].to_pylist(), (x.as_buffer() for c in table["keys"].chunks for x in c))])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for c in table["counts"].chunks for x in c])
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    counts = counts[by]
    del by
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return table["shard"][0].as_py(), keys[at], np.add.reduceat(counts, at, dtype=np.int64)


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of start, words and end of every row in a row; where each row starts; whether a place is a start."""
    words = Words(data, offsets)
    count = np.diff(words.bounds)
    first = np.concatenate([[0], np.cumsum(count + 2)])
    out = np.full(first[-1], END, dtype=np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    out[np.arange(len(row)) + 2 * row + 1] = words.hash >> _U(1)
    start = np.zeros(len(out), dtype=bool)
    start[first[:-1]] = True
    return out, first, start


# lookup ------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> dict[str, np.ndarray]:
    return map_arrays(path)


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those of 255 and more stand apart."""
    more = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "more_at": more, "more": counts[more]}


def _counts_at(arrays: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    out = arrays["count"][i].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = arrays["more"][np.searchsorted(arrays["more_at"], i[large])]
    return out


def _vocab_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> _U(31)) * _U(shards)) >> _U(32)).astype(np.int64)


def word_numbers(meta: Meta, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (or -1) and count of each word hash."""
    unique, inverse = np.unique(hashes, return_inverse=True)
    number, count = np.full(len(unique), -1, dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
    shards = len(meta.vocab) - 1
    which = _vocab_shard(unique, shards)
    edges = np.searchsorted(which, np.arange(shards + 1))
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if a < b and meta.vocab[s] < meta.vocab[s + 1]:
            arrays = _mapped(f"{meta.path}/vocab-{s}")
            at = unnested("hash", arrays).find(unique[a:b])
            have = np.flatnonzero(at >= 0)
            number[a + have] = meta.vocab[s] + at[have]
            count[a + have] = _counts_at(arrays, at[have])
    return number[inverse], count[inverse]


def _above(meta: Meta, level: int) -> list[int]:
    """First node of each shard of the level above, and the end."""
    return meta.vocab if level == 2 else meta.bases[level - 1]


def _hot_place(meta: Meta, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each parent among the hot contexts, and whether it is one."""
    hot = meta.hot[level][0]
    if not len(hot):
        return np.zeros(len(parent), dtype=np.int64), np.zeros(len(parent), dtype=bool)
    place = np.minimum(np.searchsorted(hot, parent), len(hot) - 1)
    return place, hot[place] == parent


def _shards_of(meta: Meta, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A context's successors lie in its own shard, those of a hot one in the shard that the word's number gives."""
    above = _above(meta, level)
    shard = np.searchsorted(np.array(above[1:]), parent, side="right")
    _, hot = _hot_place(meta, level, parent)
    if hot.any():
        shard[hot] = (mix(parent[hot].astype(np.uint64) * _U(2) + mix(word[hot].astype(np.uint64))) % _U(len(above) - 1)).astype(np.int64)
    return shard


def _slots(meta: Meta, level: int, shard: int, parent: np.ndarray) -> np.ndarray:
    """Numbers of contexts among a shard's pointers: its own nodes, then all hot contexts."""
    above = _above(meta, level)
    place, hot = _hot_place(meta, level, parent)
    return np.where(hot, above[shard + 1] - above[shard] + place, parent - above[shard])


def descend(meta: Meta, level: int, parent: np.ndarray, word: np.ndarray, weights: bool = True):
    """Of each (context, word): node (or -1), discounted probability (0 without a node), back-off weight (1 without the context).

    Equal pairs are asked for once, and contexts once for all their words, in the order in which they are stored.
    """
    pairs, inverse = np.unique((np.maximum(parent, -1) + 1).astype(np.uint64) << _U(meta.bits + 1) | (word + 1).astype(np.uint64), return_inverse=True)
    parent = (pairs >> _U(meta.bits + 1)).astype(np.int64) - 1
    word = (pairs & _U((2 << meta.bits) - 1)).astype(np.int64) - 1
    n = len(pairs)
    node, prob, back = np.full(n, -1, dtype=np.int64), np.zeros(n), np.ones(n)
    base = meta.bases[level]
    ask = np.flatnonzero(parent >= 0)
    if len(meta.hot[level][0]):
        shard = _shards_of(meta, level, parent[ask], word[ask])
        by = np.lexsort((_hot_place(meta, level, parent[ask])[1], shard))  # a shard's hot contexts come last
        ask, edges = ask[by], np.searchsorted(shard[by], np.arange(len(base)))
    else:
        edges = np.searchsorted(parent[ask], np.array(_above(meta, level)))
    for s in range(len(base) - 1):
        here = ask[edges[s] : edges[s + 1]]
        if not len(here) or base[s] == base[s + 1]:
            continue
        arrays = _mapped(f"{meta.path}/level{level}-{s}")
        pointers, successors = (unnested(k, arrays) for k in ("ptr", "suc"))
        fresh = np.concatenate([[True], parent[here[1:]] != parent[here[:-1]]])
        slot = _slots(meta, level, s, parent[here[fresh]])
        lo, hi = (x.astype(np.int64) for x in pointers.access_two(slot))
        known = lo < hi
        offset = np.zeros(len(lo), dtype=np.uint64)
        inner = np.flatnonzero(known & (lo > 0))
        offset[inner] = successors.access(lo[inner] - 1)
        group = np.cumsum(fresh) - 1
        real = np.flatnonzero((word[here] >= 0) & known[group])
        g, at = group[real], here[real]
        found = successors.find(word[at].astype(np.uint64) + offset[g], lo[g], hi[g])
        got = found >= 0
        node[at[got]] = base[s] + found[got]
        if weights:
            codes = _mapped(f"{meta.path}/weight{level}-{s}")
            prob[at[got]] = codes["prob_book"][codes["prob"][found[got]]]
            seen = known[group]
            back[here[seen]] = codes["back_book"][codes["back"][slot[group[seen]]]]
    if weights:
        place, is_hot = _hot_place(meta, level, parent)
        if is_hot.any():
            back[is_hot] = meta.hot_weight[level][place[is_hot]]
    return node[inverse], prob[inverse], back[inverse]


# building ----------------------------------------------------------------------------------------------------


def _build_vocab(meta_path: str) -> Callable[[pa.Table], pa.Table]:
    def build(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        save_arrays(f"{meta_path}/vocab-{shard}", nested("hash", EliasFano.build(keys)) | _small(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    return build


def _kinds(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many successors of each context were seen once, twice, more often, (3, contexts)."""
    return np.stack([np.add.reduceat((counts == i) if i < 3 else (counts >= 3), first, dtype=np.int64) for i in (1, 2, 3)])


def _build_level(meta: Meta, level: int, threshold: int) -> Callable[[pa.Table], pa.Table]:
    """Merge and write a shard; report its size, counts of counts, the parts of hot contexts and heavy nodes."""

    def build(table: pa.Table) -> pa.Table:
        out = level_of(table)
        release_memory()
        return out

    def level_of(table: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(table)
        parent, word = (keys >> _U(meta.bits)).astype(np.int64), keys & _U((1 << meta.bits) - 1)
        del keys
        hot = _hot_place(meta, level, parent)[1]
        if hot.any():  # behind the shard's own nodes
            by = np.argsort(hot, kind="stable")
            parent, word, counts = parent[by], word[by], counts[by]
        slot = _slots(meta, level, shard, parent)
        above, n_hot = _above(meta, level), len(meta.hot[level][0])
        slots = above[shard + 1] - above[shard] + n_hot
        pointers = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=slots))])
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        ends = np.concatenate([first[1:], [len(slot)]])
        offset = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word[ends - 1])[:-1]])
        arrays = nested("ptr", EliasFano.build(pointers)) | nested("suc", EliasFano.build(word + np.repeat(offset, ends - first)))
        save_arrays(f"{meta.path}/level{level}-{shard}", arrays)
        del arrays, slot, word, parent
        save_arrays(f"{meta.path}/counts{level}-{shard}", _small(counts))
        own = pointers[slots - n_hot :]  # of the hot contexts
        kinds = np.array([[((counts[a:b] == i) if i < 3 else (counts[a:b] >= 3)).sum() for a, b in zip(own, own[1:])] for i in (1, 2, 3)], dtype=np.int64)
        heavy = np.flatnonzero(counts > threshold)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "n": [len(counts)], "seen": [[int((counts == i).sum()) for i in (1, 2, 3, 4)]],
            "kinds": pa.array([kinds.ravel()], pa.list_(pa.int64())), "heavy": pa.array([heavy], pa.list_(pa.int64())), "heavy_n": pa.array([counts[heavy]], pa.list_(pa.int64())),
        })

    return build


def _book(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 quantiles of all logarithms and 128 even steps from the least to the largest, and the nearest one of each value."""
    if not len(values):
        return np.ones(1), np.zeros(0, dtype=np.uint8)
    logs = np.log(values)
    book = np.unique(np.concatenate([np.linspace(logs.min(), logs.max(), 128), np.quantile(logs, np.linspace(0, 1, 128))]))
    code = np.searchsorted((book[1:] + book[:-1]) / 2, logs)
    return np.exp(book), code.astype(np.uint8)


def _write_weights(meta: Meta, level: int, shard: int) -> None:
    """Quantised probabilities and back-off weights of a shard, once the discounts are known."""
    kept = _mapped(f"{meta.path}/counts{level}-{shard}")
    counts = _counts_at(kept, np.arange(len(kept["count"])))
    pointers = unnested("ptr", _mapped(f"{meta.path}/level{level}-{shard}"))
    start = pointers.all().astype(np.int64)
    full = np.flatnonzero(np.diff(start))  # contexts with successors
    first, size = start[full], np.diff(start)[full]
    total = np.add.reduceat(counts, first)
    hot_total = meta.hot[level][1]
    place = full - (pointers.n - 1 - len(hot_total))
    total[place >= 0] = hot_total[place[place >= 0]]
    d = np.array(meta.discounts[level])
    prob = (counts - d[np.minimum(counts, 3) - 1]) / np.repeat(total, size)
    back = (d[:, None] * _kinds(counts, first)).sum(0) / total
    prob_book, prob_code = _book(np.maximum(prob, 1e-300))
    back_book, code = _book(np.clip(back, 1e-12, 1))
    back_code = np.zeros(pointers.n - 1, dtype=np.uint8)
    back_code[full] = code
    save_arrays(f"{meta.path}/weight{level}-{shard}", {"prob_book": prob_book, "prob": prob_code, "back_book": back_book, "back": back_code})


def _discounts(seen: np.ndarray) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice, more often, from how many n-grams were seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(found))


def _edges(sizes: dict[int, int], shards: int) -> list[int]:
    return [0, *np.cumsum([sizes.get(s, 0) for s in range(shards)]).tolist()]


def train(docs: DataFrame, order: int = ORDER) -> Meta:
    """Count all n-grams of the documents up to the order and build the trie in the shared folder.

    Shards grow in number with the tokens, and so do the tasks that build them. What reaches the driver is a row for each shard. Keys are a context's node and a word in 64 bits, which
    bounds contexts times words by 2**62.
    """
    spark = docs.sparkSession
    path = local_path(new_path(spark, "ngram-trie"))
    os.makedirs(path, exist_ok=True)
    meta = Meta(path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (SHARD_TOKENS * 6)))

    def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        stream, _, start = _stream(data, offsets)
        return stream[~start]

    blobs = _counted(docs, hashes, lambda keys: _vocab_shard(keys, shards))
    rows = blobs.repartition(shards, "shard").groupBy("shard").applyInArrow(_build_vocab(path), "shard int, n long, tokens long").collect()
    meta.vocab = _edges({r["shard"]: r["n"] for r in rows}, shards)
    meta.tokens, meta.distinct = sum(r["tokens"] for r in rows), meta.vocab[-1]
    meta.bits = max(1, meta.distinct.bit_length())
    threshold = max(HOT_TOKENS, meta.tokens // 1000)
    hot = [(meta.vocab[r["shard"]] + i, n) for r in rows for i, n in _heavy_words(path, r["shard"], threshold)]
    for level in range(2, order + 1):
        meta.hot[level] = tuple(np.array([h[i] for h in sorted(hot)], dtype=np.int64) for i in range(2))
        parents = meta.bases[level - 1][-1] if level > 2 else meta.distinct
        if parents.bit_length() + meta.bits > 62:
            raise ValueError(f"order {level}: {parents} contexts times {meta.distinct} words don't fit into 62 bits; lower the order")
        hot = _train_level(docs, meta, level, shards, threshold)
    return meta


def _heavy_words(path: str, shard: int, threshold: int) -> list[tuple[int, int]]:
    arrays = map_arrays(f"{path}/vocab-{shard}")  # HOT_TOKENS is over 255
    return [(int(i), int(n)) for i, n in zip(arrays["more_at"], arrays["more"]) if n > threshold]


def _train_level(docs: DataFrame, meta: Meta, level: int, shards: int, threshold: int) -> list[tuple[int, int]]:
    """Build one level and return its nodes with more tokens than the threshold."""
    spark = docs.sparkSession

    def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parent, word = _contexts(meta, level, data, offsets)
        keep = parent >= 0
        return (parent[keep].astype(np.uint64) << _U(meta.bits)) | word[keep].astype(np.uint64)

    def shard_of(k: np.ndarray) -> np.ndarray:
        return _shards_of(meta, level, (k >> _U(meta.bits)).astype(np.int64), (k & _U((1 << meta.bits) - 1)).astype(np.int64))

    fields = "shard int, n long, seen array<long>, kinds array<long>, heavy array<long>, heavy_n array<long>"
    rows = _counted(docs, keys, shard_of).repartition(shards, "shard").groupBy("shard").applyInArrow(_build_level(meta, level, threshold), fields).collect()
    base = _edges({r["shard"]: r["n"] for r in rows}, shards)
    seen = np.sum([r["seen"] for r in rows], axis=0) if rows else np.zeros(4)
    meta.bases[level], meta.discounts[level] = base, _discounts(seen)
    total = meta.hot[level][1]
    kinds = sum((np.array(r["kinds"]).reshape(3, -1) for r in rows), np.zeros((3, len(total))))
    meta.hot_weight[level] = np.array(meta.discounts[level]) @ kinds / np.maximum(total, 1)
    built = [r["shard"] for r in rows]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                _write_weights(meta, level, s)
            release_memory()
            yield batch

    if built:
        spark.createDataFrame([(s,) for s in built], "shard int").repartition(len(built)).mapInArrow(weigh, "shard int").count()
        for s in built:
            os.remove(f"{meta.path}/counts{level}-{s}")
    return [(base[r["shard"]] + i, n) for r in rows for i, n in zip(r["heavy"], r["heavy_n"])]


def _contexts(meta: Meta, level: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) of all places in training text that have a context of level - 1 words."""
    stream, _, start = _stream(data, offsets)
    word, _ = word_numbers(meta, stream)
    parent = np.full(len(word), -1, dtype=np.int64)
    parent[1:] = word[:-1]
    parent[start] = -1
    for k in range(2, level):
        node, _, _ = descend(meta, k, parent, word, weights=False)
        parent[1:] = node[:-1]
        parent[0] = -1
        parent[start] = -1
    return parent, word


# scoring -----------------------------------------------------------------------------------------------------


def text_scores(meta: Meta, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score, model score of each row; scores are sums of log10."""
    stream, first, start = _stream(data, offsets)
    word, count = word_numbers(meta, stream)
    unigram = (count + 1) / (meta.tokens + meta.distinct + 1)
    prob = unigram.copy()
    parent = np.full(len(word), -1, dtype=np.int64)
    parent[1:] = word[:-1]
    parent[start] = -1
    for level in sorted(meta.bases):
        node, own, back = descend(meta, level, parent, word)
        prob = own + back * prob
        parent[1:] = node[:-1]
        parent[0] = -1
        parent[start] = -1
    base, model, known = np.log10(unigram), np.log10(prob), (count > 0).astype(np.int64)
    base[start] = model[start] = known[start] = 0
    rows = first[:-1]
    return np.diff(first) - 1, *(np.add.reduceat(x, rows) for x in (known, base, model))


def scored(docs: DataFrame, meta: Meta) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score. A null text is empty: its end alone is scored."""

    def kernel(batch: pa.RecordBatch):
        for a, b, data, offsets in text_slices(batch.column(0), LOOKUP_BYTES):
            n, known, base, model = text_scores(meta, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.array(n), pa.array(known), pa.array(base), pa.array(model)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return arrow_map(
        docs.select("text", "doc_id"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double"
    )


def document_scores(docs: DataFrame, order: int = ORDER, folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from documents outside the held-out fold; a null id is held out. Repeated rows count as often as
    they come. A null or empty text is one token, its end. Without a training document every token has probability 1. An
    empty table gives no rows; other columns are ignored.
    """
    held = fold(F.col("doc_id"), folds) == held_out_fold
    meta = train(docs.where(~held), order)
    return scored(docs, meta).select(
        "doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "n_tokens", "n_known", F.lit(meta.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
