"""Vectorised word kernels over Arrow text columns.

A slice of an Arrow string column is one UTF-8 byte buffer; words are found with byte-class tables and
hashed to 64 bits with prefix sums of a polynomial, so that no Python object is made for a word. Slices are
bounded in bytes (a longer text is a slice of its own), which bounds the memory of a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once by the kernels; memory is about 40 times this.
SLICE_BYTES = 1 << 19
#: Words longer than this are hashed one by one with xxh3.
LONG_WORD = 64

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = int(_rng.integers(1, 1 << 62)) * 4 + 3
_RINV = pow(_R, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes: 1 where a byte belongs to a word.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_pows: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), dtype=np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            step = min(done, len(out) - done)
            np.multiply(out[:step], _U(pow(base, done, 1 << 64)), out=out[done : done + step])
            done += step
        _pows[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64 bits with avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive row ranges; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def pieces(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """One text in pieces of about ``limit`` bytes, cut after a space; a word over ``limit`` bytes stays whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            space = np.flatnonzero(~SPACE_WORDS[data[end : end + limit]])
            if len(space):
                end += int(space[0]) + 1
                break
            end = min(len(data), end + limit)
        yield data[at:end]
        at = end


class Words:
    """Words of a slice: start, end (bytes), hash, and bounds of each row's words."""

    __slots__ = ("start", "end", "hash", "bounds", "low")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORDS, hashes: bool = True):
        low = LOWER[data]
        inside = kind[low]
        n = len(low)
        begins = np.empty(n, dtype=bool)
        if n:
            begins[0] = inside[0]
            np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
            cut = offsets[1:-1]
            cut = cut[cut < n]
            begins[cut] = inside[cut]
            stops = np.empty(n, dtype=bool)
            stops[-1] = inside[-1]
            np.logical_and(inside[:-1], ~inside[1:], out=stops[:-1])
            last = offsets[1:-1]
            last = last[last > 0] - 1
            stops[last] = inside[last]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(stops) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.low = low
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = span_hash(low, self.start, self.end, LONG_WORD) if hashes else None


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, long: int) -> np.ndarray:
    """64-bit hashes of ascending spans of bytes that don't overlap; equal bytes have equal hashes.

    Prefix sums are taken over blocks of spans, so a text of any length needs no more than a block of them.
    Spans over ``long`` bytes are hashed one by one with xxh3.
    """
    size = end - start
    out = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + SLICE_BYTES)))
        short = first + np.flatnonzero(size[first:last] <= long)
        if len(short):
            at = int(start[short[0]])
            part = data[at : int(end[short[-1]])]
            prefix = np.empty(len(part) + 1, dtype=np.uint64)
            prefix[0] = 0
            np.cumsum(_BYTE[part] * _powers(_R, len(part)), out=prefix[1:])
            s, e = start[short] - at, end[short] - at
            out[short] = mix((prefix[e] - prefix[s]) * _powers(_RINV, len(part) + 1)[s] + size[short].astype(np.uint64))
        first = last
    for i in np.flatnonzero(size > long):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def word_hash(word: bytes) -> int:
    """The hash that ``Words`` gives to one word."""
    return int(Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash[0])


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes (len - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m].copy() if n > 1 else words[:m]
    for i in range(1, n):
        out = mix(out) * _U(0x9E3779B97F4A7C15) + words[i : i + m]
    return mix(out + _U(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; with fewer words the whole sequence is one, without words none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(ngram_hash(words, min(n, len(words))))
