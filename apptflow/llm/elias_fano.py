"""Elias-Fano sequences over flat arrays, searched many values at a time.

A non-decreasing sequence of n values below u takes about 2 + log2(u / n) bits a
value: the low bits packed, the high bits as a bit vector with one set bit a
value.  Search and access go by selecting zeros or ones; the only extra is one
32-bit count for every 64 bits of the vector.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SELECT = np.zeros((256, 8), np.uint8)       # place of the r-th set bit of a byte
_ONES = _U(0x0101010101010101)
for _b in range(256):
    for _r, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _r] = _i


def _byte_counts(x: np.ndarray) -> np.ndarray:
    """Set bits of each byte of 64-bit words, in that byte."""
    x = x - ((x >> _U(1)) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    return (x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of sorted uint64 values below ``universe``: head (n, low bits,
    words), low, high, ones (set bits before each word of ``high``)."""
    n = len(values)
    bits = max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))
    low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
    if n and bits:
        mask = _U((1 << bits) - 1)
        step = 1 << 16                        # pack by slices, to bound the unpacked bits
        step -= step % 8
        for a in range(0, n, step):
            part = (values[a:a + step] & mask)[:, None] >> np.arange(bits, dtype=np.uint64) & _U(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            low[a * bits // 8:a * bits // 8 + len(packed)] = packed
    size = n + (universe >> bits) + 1
    words = size // 64 + 1
    high = np.zeros(words, np.uint64)
    at = (values >> _U(bits)) + np.arange(n, dtype=np.uint64)
    if n:
        word = (at >> _U(6)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        high[word[begin]] = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), begin)
    ones = np.zeros(words + 1, np.uint32)
    ones[1:] = np.cumsum((_byte_counts(high) * _ONES) >> _U(56))
    return {"head": np.array([n, bits, words], np.int64), "low": low, "high": high, "ones": ones}


DTYPES = {"head": "<i8", "low": "u1", "high": "<u8", "ones": "<u4"}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.words = (int(x) for x in arrays["head"])
        self.high, self.ones = arrays["high"], arrays["ones"]
        raw = np.ascontiguousarray(arrays["low"]) if not arrays["low"].flags["C_CONTIGUOUS"] else arrays["low"]
        # every byte position as the start of a 64-bit word
        self.low = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
        self.mask = _U((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) set or clear bit of the high bits."""
        if ones:
            word = np.searchsorted(self.ones, k, side="right") - 1
            before = self.ones[word].astype(np.int64)
        else:
            if not hasattr(self, "zeros"):
                self.zeros = np.arange(self.words + 1, dtype=np.int64) * 64 - self.ones
            word = np.searchsorted(self.zeros, k, side="right") - 1
            before = self.zeros[word]
        x = self.high[word]
        if not ones:
            x = ~x
        # byte i of acc: set bits up to and with byte i
        acc = _byte_counts(x) * _ONES
        r = (k - before).astype(np.uint8)
        byte = (acc.view(np.uint8).reshape(-1, 8) <= r[:, None]).sum(axis=1, dtype=np.uint64)
        shift = byte << _U(3)
        r -= ((acc << _U(8)) >> shift).astype(np.uint8)
        return word * 64 + (shift + _SELECT[(x >> shift).astype(np.uint8), r]).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.bits)) | self._low(i)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value below the universe: the position of its successor (the
        first value not below it) and whether it is equal."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        h = (x >> _U(self.bits)).astype(np.int64)
        # the values with high bits h are the set bits behind the zero before h
        at = np.zeros(len(x), np.int64)
        later = h > 0
        at[later] = self._select(h[later] - 1, False) + 1
        lo = at - h
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, self.words - 1)]
        run = (self.high[word] >> bit) | np.where(bit > 0, after << ((_U(64) - bit) & _U(63)), _U(0))
        stop = ~run & (run + _U(1))            # the first clear bit, alone
        hi = lo + np.log2(np.maximum(stop, _U(1)).astype(np.float64)).astype(np.int64)
        far = (stop == 0) | ((word + 1 >= self.words) & (hi - lo + (at & 63) >= 64))
        if far.any():
            hi[far] = self._select(h[far], False) - h[far]
        end, want = hi.copy(), x & self.mask
        live = np.flatnonzero(lo < hi)
        while len(live):                      # binary search of the low bits, all side by side
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        found = lo < end
        found[found] = self._low(lo[found]) == want[found]
        return lo, found
