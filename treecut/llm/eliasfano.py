"""Elias-Fano sequences, read in place from a buffer."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_ONE = np.uint64(1)
_SIX = np.uint64(6)
_63 = np.uint64(63)


class EliasFano:
    """A non-decreasing sequence of non-negative integers: the low bits packed,
    the high bits in unary, and the number of ones before each 64-bit word.
    All methods take and give arrays."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank
        self.zeros = np.arange(len(rank), dtype=np.int64) * 64 - rank  # zeros before each word

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        largest = int(values[-1]) if n else 0
        bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        at = np.arange(n, dtype=np.uint64)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            part, first = values & np.uint64((1 << bits) - 1), at * np.uint64(bits)
            word, shift = (first >> _SIX).astype(np.int64), first & _63
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)) + at
        high = np.zeros((n + (largest >> bits)) // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(high, (place >> _SIX).astype(np.int64), _ONE << (place & _63))
        ones = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(ones) - ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        first = i * self.low_bits
        word, shift = first >> 6, (first & 63).astype(np.uint64)
        value = self.low[word] >> shift
        rest = np.uint64(64) - shift
        value |= np.where(shift > 0, self.low[word + 1] << (rest & _63), np.uint64(0))
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, word: np.ndarray, nth: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the ``nth`` one (or zero) of each word, by halving."""
        bits = self.high[word] if ones else ~self.high[word]
        place, nth = np.zeros(len(word), dtype=np.uint64), nth.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            own = np.bitwise_count((bits >> place) & mask).astype(np.int64)
            beyond = nth >= own
            nth = np.where(beyond, nth - own, nth)
            place = np.where(beyond, place + np.uint64(width), place)
        return word * 64 + place.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.rank, i, side="right") - 1
        return ((self._select(word, i - self.rank[word], True) - i) << self.low_bits) | self._low(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a smaller high part."""
        out = np.zeros(len(high), dtype=np.int64)
        some = high > 0
        nth = high[some] - 1
        total = len(self.high) * 64 - self.n
        nth_in = np.minimum(nth, total - 1)
        word = np.searchsorted(self.zeros, nth_in, side="right") - 1
        found = self._select(word, nth_in - self.zeros[word], False) - nth_in
        out[some] = np.where(nth < total, found, self.n)
        return out

    def successor(self, target: np.ndarray) -> np.ndarray:
        """Place of the first element >= ``target`` (``n`` if there is none)."""
        high, low = target >> self.low_bits, target & ((1 << self.low_bits) - 1)
        lo, hi = self._before(high), self._before(high + 1)
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], dtype=np.int64), self.low, self.high, self.rank]

    @classmethod
    def from_parts(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, rank)


def pack(arrays: list[np.ndarray]) -> tuple[bytes, list[tuple[str, int, int]]]:
    """One buffer for ``arrays``, and where each lies (type, offset, length)."""
    out, at, where = [], 0, []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        where.append((a.dtype.str, at, len(a)))
        out.append(raw + b"\0" * (-len(raw) % 8))
        at += len(out[-1])
    return b"".join(out), where


def mapped(buffer: bytes, where: list[tuple[str, int, int]]) -> list[np.ndarray]:
    """The arrays of ``pack`` as views of a memory-mapped file without a name:
    it is gone when the process ends, and pages in as it is read."""
    with tempfile.TemporaryFile() as file:
        file.write(buffer or b"\0")
        file.flush()
        area = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(area, dtype=kind, count=n, offset=at) for kind, at, n in where]
