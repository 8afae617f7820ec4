"""Elias-Fano sequences over arrays that can be memory-mapped, with vectorised access and search."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_U = np.uint64
_ONE = _U(1)


def _low_bits(n: int) -> np.uint64:
    return _U((1 << n) - 1)


def _places_in_bytes() -> np.ndarray:
    """Position of the k-th set bit of each byte, at byte * 8 + k (0 where there is none)."""
    out = np.zeros((256, 8), dtype=np.uint8)
    for byte in range(256):
        set_bits = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(set_bits)] = set_bits
    return out.ravel()


_IN_BYTE = _places_in_bytes()
_EACH = _U(0x0101010101010101)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word: its byte by the set bits up to each byte, then a table."""
    upto = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _EACH  # byte i: set bits of bytes 0 to i
    k = k.astype(np.uint64)
    full = ((k * _EACH | _EACH << _U(7)) - upto) & _EACH << _U(7)  # bytes with no more than k set bits up to their end
    at = np.bitwise_count(full).astype(np.uint64) << _U(3)
    k -= (upto << _U(8)) >> at & _U(255)
    return (at + _IN_BYTE[(word >> at & _U(255)) << _U(3) | k]).astype(np.int64)


def _lowest(word: np.ndarray) -> np.ndarray:
    """Position of the lowest set bit of each word (64 without one)."""
    return np.bitwise_count(~word & (word - _ONE)).astype(np.int64)


class EliasFano:
    """A monotone sequence of n numbers below 2**63: low bits packed, high bits in unary, ones and zeros counted by word.

    Positions to look up should ascend, so that the searches for their words stay in the processor's cache.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.n, self.width, self.buckets = (int(x) for x in parts["meta"])
        self.low, self.up, self.ones, self.zeros = (parts[k] for k in ("low", "up", "ones", "zeros"))

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(width)).astype(np.int64)
        buckets = (int(high[-1]) if n else 0) + 1
        length = n + buckets
        bits = np.zeros(-(-length // 64) * 64 + 64, dtype=bool)  # a word more than needed, so that a run may be looked at past its word
        bits[high + np.arange(n)] = True
        bits[length:-64] = True  # no zeros past the end
        up = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(up[:-1]), dtype=np.int64)])
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        kind = np.uint32 if length < 1 << 32 else np.int64
        low = np.zeros(-(-n * width // 64) + 1, dtype=np.uint64)
        if width:
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            part = values & _low_bits(width)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift.astype(np.int64) + width > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        return cls({"meta": np.array([n, width, buckets], dtype=np.int64), "low": low, "up": up, "ones": ones.astype(kind), "zeros": zeros.astype(kind)})

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero with ``flip``, among the upper bits."""
        word = np.searchsorted(counts, k.astype(counts.dtype), side="right") - 1
        bits = ~self.up[word] if flip else self.up[word]
        return word * 64 + _select_in_word(bits, k - counts[word].astype(np.int64))

    def _after(self, place: np.ndarray, flip: bool) -> np.ndarray:
        """The first one at or after each place, or zero with ``flip``."""
        word = place >> 6
        bits = (~self.up[word] if flip else self.up[word]) >> (place & 63).astype(np.uint64)
        out = place + _lowest(bits)
        far = np.flatnonzero(bits == 0)
        if len(far):  # none is left in the word: the next one is the first that isn't counted up to the word's end
            counts = self.zeros if flip else self.ones
            out[far] = self._select(counts[word[far] + 1].astype(np.int64), counts, flip)
        return out

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift.astype(np.int64) + self.width > 64)
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _low_bits(self.width)

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(np.uint64) << _U(self.width)) | self._low_at(i)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        return self._value(i, self._select(i, self.ones, False))

    def all(self) -> np.ndarray:
        """All numbers in order: the upper bits are read through once."""
        place = np.flatnonzero(np.unpackbits(self.up.view(np.uint8), bitorder="little").view(bool))[: self.n]
        return self._value(np.arange(self.n), place)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and the next ones."""
        place = self._select(i, self.ones, False)
        return self._value(i, place), self._value(i + 1, self._after(place + 1, False))

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each x (within lo <= index < hi if given), or -1: a successor search in x's bucket."""
        out = np.full(len(x), -1, dtype=np.int64)
        bucket = x >> _U(self.width)
        ask = np.flatnonzero(bucket < _U(self.buckets)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return out
        b = bucket[ask].astype(np.int64)
        begin = np.where(b > 0, self._select(np.maximum(b, 1) - 1, self.zeros, True) + 1, 0)
        start, end = begin - b, self._after(begin, True) - b
        if lo is not None:
            whole = len(ask) == len(x)
            start, end = np.maximum(start, lo if whole else lo[ask]), np.minimum(end, hi if whole else hi[ask])
        want = x[ask] & _low_bits(self.width)
        # most buckets hold a number or two: those are looked at one by one, larger ones by halves
        for step in range(4):
            if step:
                start = start + 1
            left = np.flatnonzero(start < end)
            if len(left) < len(start):
                ask, start, end, want = ask[left], start[left], end[left], want[left]
            if step == 3 or not len(ask):
                break
            got = self._low_at(start)
            hit = got == want
            out[ask[hit]] = start[hit]
            left = np.flatnonzero(got < want)
            ask, start, end, want = ask[left], start[left], end[left], want[left]
        stop, active = end.copy(), np.arange(len(ask))
        while len(active):
            mid = (start[active] + end[active]) >> 1
            less = self._low_at(mid) < want[active]
            start[active[less]] = mid[less] + 1
            end[active[~less]] = mid[~less]
            active = active[start[active] < end[active]]
        inside = np.flatnonzero(start < stop)
        hit = inside[self._low_at(start[inside]) == want[inside]]
        out[ask[hit]] = start[hit]
        return out


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: header with names and places, then the arrays, each at a multiple of 64 bytes. The file appears whole."""
    head, at, chunks = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, list(a.shape), at]
        pad = -a.nbytes % 64
        chunks.append((a, pad))
        at += a.nbytes + pad
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a, pad in chunks:
            f.write(memoryview(a).cast("B") if a.nbytes else b"")
            f.write(b"\0" * pad)
    os.replace(temporary, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for name, (kind, shape, at) in head.items():
        nbytes = np.dtype(kind).itemsize * int(np.prod(shape))
        out[name] = np.asarray(raw[8 + size + at : 8 + size + at + nbytes]).view(kind).reshape(shape)
    return out


def nested(prefix: str, sequence: EliasFano) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in sequence.parts.items()}


def unnested(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")})
