"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items (or fixed windows of them) are sets of word shingles, ordered by rarity in the documents. To
hold a share t of a set S, a stretch of text must hold one of its |S| - ceil(t |S|) + 1 rarest shingles, so
only those are joined with the documents' shingles. Where one is found, length and position bound the
stretch of text it can belong to, and the containment is verified there on the whole set (for t = 1: word by
word). The benchmark side is an index of bounded size; a larger benchmark is indexed in several blocks, and the
documents are looked through by one block after the other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, marked
from .textkit import ALNUM_WORDS, Words, ngram_hash, text_slices

SHINGLE = 5
THRESHOLD = 0.8
WINDOW = 10
#: Text bytes of one block of the benchmark. A block is collected, built and broadcast; in memory it takes about 40 bytes
#: for a word of its items, and as much again for each of their windows (about 60 MB for a block of 4 MB).
BLOCK_BYTES = 4 << 20

_BITS = 1 << 20


class Block:
    """Units (items, or windows of items) of one block, as places in one array of the items' words, and what is joined of them."""

    def __init__(self, texts: list[np.ndarray], ids: list, shingle: int, threshold: float, window: int | None):
        """texts: word hashes of items with words; ids: theirs (None: counted as no item)."""
        self.threshold, self.shingle, self.ids = threshold, shingle, ids
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        self.words = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        unit = np.minimum(window, sizes) if window else sizes
        n = sizes - unit + 1
        item = np.repeat(np.arange(len(sizes)), n)
        start = self.begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        key = [ngram_hash(w, int(u)) for w, u in zip(texts, unit)]
        _, at, which = np.unique(np.concatenate(key) if key else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        self.start, self.size = start[at], unit[item[at]]
        self.step = np.minimum(shingle, self.size)
        # the items of each unit, unit after unit
        pairs = np.unique(which * max(1, len(ids)) + item)
        self.item_of, owner = pairs % max(1, len(ids)), pairs // max(1, len(ids))
        self.item_bounds = np.searchsorted(owner, np.arange(len(at) + 1))

    def items(self, unit: int) -> list:
        """Ids of the items that have the unit."""
        return [self.ids[i] for i in self.item_of[self.item_bounds[unit] : self.item_bounds[unit + 1]] if self.ids[i] is not None]

    def shingles(self, unit: int) -> np.ndarray:
        return ngram_hash(self.words[self.start[unit] : self.start[unit] + self.size[unit]], int(self.step[unit]))

    def vocabulary(self) -> dict[int, np.ndarray]:
        """All shingles by their length in words."""
        out = {}
        for s in np.unique(self.step).tolist():
            which = np.flatnonzero(self.step == s)
            place = np.repeat(self.start[which], self.size[which] - s + 1)
            n = self.size[which] - s + 1
            place += np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            out[s] = np.unique(ngram_hash(self.words, s)[np.unique(place)])
        return out

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose what is joined, given the shingles that the documents have (sorted) and how often, by length."""
        self.joined = {}
        for s in np.unique(self.step).tolist():
            keys, n = counts.get(s, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            every = ngram_hash(self.words, s)
            at = np.minimum(np.searchsorted(keys, every), max(0, len(keys) - 1))
            often = np.where(keys[at] == every, n[at], 0) if len(keys) else np.zeros(len(every), np.int64)
            which = np.flatnonzero(self.step == s)
            if self.threshold >= 1:
                units, offsets = which, self._rarest(which, s, every, often)
            else:
                units, offsets = self._prefixes(which, every, often)
            chosen = every[self.start[units] + offsets]
            by = np.argsort(chosen, kind="stable")
            self.joined[s] = (chosen[by], units[by], offsets[by], _bitmap(chosen))

    def _rarest(self, units: np.ndarray, s: int, every: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Offset of each unit's rarest shingle (ties: the smallest hash, then the first place)."""
        best = np.zeros(len(units), dtype=np.int64)
        for k in range(1, int((self.size[units] - s).max()) + 1 if len(units) else 0):
            has = np.flatnonzero(self.size[units] - s >= k)
            new, old = self.start[units[has]] + k, self.start[units[has]] + best[has]
            rarer = (often[new] < often[old]) | ((often[new] == often[old]) & (every[new] < every[old]))
            best[has[rarer]] = k
        return best

    def _prefixes(self, units: np.ndarray, every: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, offset) of the |S| - ceil(t |S|) + 1 rarest distinct shingles of each unit."""
        out = []
        for u in units.tolist():
            a, n = int(self.start[u]), int(self.size[u] - self.step[u] + 1)
            h, first = np.unique(every[a : a + n], return_index=True)
            by = first[np.lexsort((h, often[a + first]))]
            out.append((u, by[: len(h) - math.ceil(self.threshold * len(h) - 1e-9) + 1]))
        none = np.zeros(0, dtype=np.int64)
        return (np.repeat([u for u, _ in out], [len(o) for _, o in out]), np.concatenate([o for _, o in out])) if out else (none, none)

    def found(self, words: Words, row_of: np.ndarray):
        """Candidate (word position, unit, offset of the shingle in the unit) in a slice."""
        hi = words.bounds[1:]
        for s, (keys, units, offsets, bits) in self.joined.items():
            h = ngram_hash(words.hash, s)
            at = np.flatnonzero(bits[h & np.uint64(_BITS - 1)])
            at = at[at + s <= hi[row_of[at]]]
            a, b = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            n = b - a
            pos = np.repeat(at, n)
            entry = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(pos):
                yield pos, units[entry], offsets[entry]

    def exact(self, words: Words, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, unit) of all places where a unit stands word by word."""
        starts, which = [], []
        for pos, unit, offset in self.found(words, row_of):
            start, row = pos - offset, row_of[pos]
            fits = (start >= words.bounds[row]) & (start + self.size[unit] <= words.bounds[row + 1])
            start, unit = start[fits], unit[fits]
            same = np.ones(len(start), dtype=bool)
            for k in range(int(self.size[unit].max()) if len(unit) else 0):
                has = np.flatnonzero(same & (self.size[unit] > k))
                same[has] = words.hash[start[has] + k] == self.words[self.start[unit[has]] + k]
            starts.append(start[same])
            which.append(unit[same])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)

    def wanted(self, unit: int) -> np.ndarray:
        """The unit's distinct shingles in order, kept from one slice to the next."""
        if unit not in (held := self.__dict__.setdefault("_wanted", {})):
            held[unit] = np.unique(self.shingles(unit))
        return held[unit]

    def contained(self, words: Words, row_of: np.ndarray):
        """(row, unit, first word, words, containment): the best stretch for each row and unit at or over the threshold.

        Stretches around the candidates of a row and unit that overlap are one, which is looked through once, however many
        candidates it has.
        """
        for pos, unit, _ in self.found(words, row_of):
            s, row, m = int(self.step[unit[0]]), row_of[pos], self.size[unit]
            lo, hi = np.maximum(words.bounds[row], pos - (m - self.step[unit])), np.minimum(words.bounds[row + 1], pos + m)
            order = np.lexsort((lo, unit, row))
            row, unit, lo, hi = row[order], unit[order], lo[order], hi[order]
            same = (row[1:] == row[:-1]) & (unit[1:] == unit[:-1])
            begin = np.flatnonzero(np.concatenate([[True], ~same | (lo[1:] > hi[:-1])]))
            end = np.concatenate([begin[1:], [len(row)]]) - 1
            h = ngram_hash(words.hash, s)
            best: dict[tuple[int, int], tuple] = {}
            for r, u, a, z in zip(row[begin].tolist(), unit[begin].tolist(), lo[begin].tolist(), hi[end].tolist()):
                wanted, m = self.wanted(u), int(self.size[u])
                need = math.ceil(self.threshold * len(wanted) - 1e-9)
                if z - a - s + 1 >= need:
                    got = _best_window(h[a : z - s + 1], wanted, m - s + 1)
                    if got[0] >= need and got[0] > best.get((r, u), (0,))[0]:
                        best[r, u] = (got[0], a + got[1], min(m, z - a - got[1]), got[0] / len(wanted))
            for (r, u), (_, first, n, share) in best.items():
                yield r, u, first, n, share


def _bitmap(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, dtype=bool)
    bits[keys & np.uint64(_BITS - 1)] = True
    return bits


def _best_window(have: np.ndarray, wanted: np.ndarray, width: int) -> tuple[int, int]:
    """The most distinct wanted shingles in any ``width`` successive ones, and where that begins first.

    A shingle counts in the windows that begin after its last occurrence before and hold it; how many do begin at each place
    is a running sum.
    """
    at = np.searchsorted(wanted, have)
    at[at == len(wanted)] = 0
    place = np.flatnonzero(wanted[at] == have)
    if not len(place):
        return 0, 0
    which = at[place]
    by = np.argsort(which, kind="stable")
    before = np.full(len(place), -1)
    again = np.flatnonzero(which[by][1:] == which[by][:-1]) + 1
    before[by[again]] = place[by[again - 1]]
    first = np.maximum(np.maximum(before + 1, place - width + 1), 0)
    count = np.cumsum(np.bincount(first, minlength=len(have) + 1) - np.bincount(place + 1, minlength=len(have) + 1))
    best = int(count.argmax())
    return int(count[best]), best


def _item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM_WORDS).hash


def _blocks(docs: DataFrame, bench: DataFrame, shingle: int, threshold: float, window: int | None) -> Iterator[Broadcast]:
    """The benchmark's blocks, one after the other, each broadcast; there is one at least."""
    spark = docs.sparkSession
    bench = bench.where(F.length("text") > 0).select("item_id", "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else bench
        items = [(w, r["item_id"]) for r in part.collect() if len(w := _item_words(r["text"]))]
        block = Block([w for w, _ in items], [i for _, i in items], shingle, threshold, window)
        block.order(_rarity(docs, block))
        yield spark.sparkContext.broadcast(block)


def _rarity(docs: DataFrame, block: Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Shingles of the block that the documents have (sorted) and how often, by length."""
    vocabulary = block.vocabulary()
    if not vocabulary:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast({s: (v, _bitmap(v)) for s, v in vocabulary.items()})

    def kernel(batch: pa.RecordBatch):
        for _, _, data, offsets in text_slices(batch.column(0)):
            words = Words(data, offsets, ALNUM_WORDS)
            for s, (keys, bits) in shared.value.items():
                h = ngram_hash(words.hash, s)
                h = h[bits[h & np.uint64(_BITS - 1)]]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                which, n = np.unique(at[keys[at] == h], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(which), s, dtype=np.int32)), pa.array(keys[which].view(np.int64)), pa.array(n)], names=["s", "h", "n"]
                )

    found = arrow_map(docs.select("text"), kernel, "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n")).toArrow()
    lengths, codes, n = (found.column(i).to_numpy() for i in range(3))
    out = {}
    for s in vocabulary:
        here = lengths == s
        keys = codes[here].view(np.uint64)
        by = np.argsort(keys)
        out[s] = keys[by], n[here][by]
    return out


def _rows(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))


def contained_items(docs: DataFrame, bench: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, containment): items of which a document holds a share of the shingles
    at or over the threshold in a stretch as long as the item, with the best stretch.

    An item with fewer words than a shingle is one shingle. Null or empty texts on either side match nothing;
    documents with equal ids give rows of their own; an item without an id has no rows here.
    """
    id_type, item_type = dict(docs.dtypes)["doc_id"], dict(bench.dtypes)["item_id"]
    out = None
    for blocks in _blocks(docs, bench, shingle, threshold, None):

        def kernel(batch: pa.RecordBatch, shared=blocks):
            block = shared.value
            for a, b, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets, ALNUM_WORDS)
                found = block.contained(words, _rows(words))
                got = [(row, item, first - int(words.bounds[row]), n, share) for row, u, first, n, share in found for item in block.items(u)]
                if got:
                    row, item, first, n, share = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(a, b - a).take(pa.array(row)), pa.array(item), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(share)],
                        names=["doc_id", "item_id", "first_word", "n_words", "containment"],
                    )

        rows = arrow_map(
            docs.select("text", "doc_id"), kernel, f"doc_id {id_type}, item_id {item_type}, first_word long, n_words long, containment double"
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def clean_documents(docs: DataFrame, bench: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item (as in contained_items), with their own columns; texts don't move.

    Documents with a null or empty text stay, repeated rows and null ids are judged by their text, an empty benchmark
    lets all documents stay, an empty table gives no rows. A document is looked through by one block of the
    benchmark after the other.
    """
    mark = "_dec_clean"
    for blocks in _blocks(docs, bench, shingle, threshold, None):

        def kernel(texts: pa.Array, shared=blocks) -> pa.Array:
            keep = np.ones(len(texts), dtype=bool)
            for a, _, data, offsets in text_slices(texts):
                words = Words(data, offsets, ALNUM_WORDS)
                keep[[a + row for row, *_ in shared.value.contained(words, _rows(words))]] = False
            return pa.array(keep)

        docs = marked(docs, "text", mark, kernel, "boolean").where(mark).drop(mark)
    return docs


def window_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window of an item), n_items,
    items_sha256, contaminated.

    A window is so many consecutive words of an item, or a whole shorter item. A null text has no words; an item
    without an id marks words but isn't counted as an item. Repeated rows have rows of their own, null ids are
    kept, an empty benchmark hits nothing, an empty table gives no rows. With several blocks of the benchmark, the
    places hit so far go on from block to block.
    """
    blocks = list(_blocks(docs, bench, shingle, 1.0, window))
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("text", "doc_id", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("array<string>").alias("items"))
    for k, shared in enumerate(blocks):
        rows = _block_hits(rows, shared, id_type, last=k == len(blocks) - 1)
    return rows


def _block_hits(rows: DataFrame, shared: Broadcast, id_type: str, last: bool) -> DataFrame:
    """Add the hits of one block to rows (text, doc_id, places, items); after the last block come the results."""

    def kernel(batch: pa.RecordBatch):
        block = shared.value
        for a, b, data, offsets in text_slices(batch.column(0)):
            words = Words(data, offsets, ALNUM_WORDS)
            row_of = _rows(words)
            start, unit = block.exact(words, row_of)
            # occurrences as (first word, end) within their row, with those of earlier blocks
            row, first = row_of[start], start - words.bounds[row_of[start]]
            by = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[by], np.arange(b - a + 1))
            places = [np.frombuffer(x.as_py() or b"", dtype=np.int64).reshape(-1, 2) for x in batch.column(2).slice(a, b - a)]
            items = [set(x or ()) for x in batch.column(3).slice(a, b - a).to_pylist()]
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                here = by[cuts[i] : cuts[i + 1]]
                spans = np.unique(np.stack([first[here], first[here] + block.size[unit[here]]], axis=1), axis=0)
                places[i] = np.concatenate([places[i], spans])
                for u in np.unique(unit[here]).tolist():
                    items[i].update(map(str, block.items(u)))
            ids = batch.column(1).slice(a, b - a)
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), ids, pa.array([p.tobytes() for p in places], pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["text", "doc_id", "places", "items"],
                )
                continue
            n_words = np.diff(words.bounds)
            n_hit = np.zeros(b - a, dtype=np.int64)
            for i, p in enumerate(places):
                if len(p):
                    inside = np.cumsum(np.bincount(p[:, 0], minlength=n_words[i] + 1) - np.bincount(p[:, 1], minlength=n_words[i] + 1))
                    n_hit[i] = np.count_nonzero(inside[:-1])
            found = [sorted(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]), pa.array(n_hit > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    if not last:
        return arrow_map(rows, kernel, f"text string, doc_id {id_type}, places binary, items array<string>")
    return arrow_map(rows, kernel, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
