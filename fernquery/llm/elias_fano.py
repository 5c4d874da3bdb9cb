"""Elias-Fano sequences in NumPy: monotone numbers in few bits, searched without unpacking.

Each of n numbers below u keeps its low bits as they are; the high parts are written in
unary, a one per number and a zero per step. A sequence that is searched keeps three low
bits more than the floor(log2(u / n)) that take the least room, so that its unary part is
short, and beside it the place of every zero: the numbers that share a high part are
found by two reads. All queries take and return arrays. The arrays are plain, so they can
be memory-mapped.
"""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _AT[b, r]: place of the r-th one of byte b.
_AT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(i for i in range(8) if _b >> i & 1):
        _AT[_b, _r] = _p
#: Low bits at most: as many as eight bytes hold wherever in a byte they begin.
WIDEST = 56


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of that rank in each 64-bit word."""
    parts = words.view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_POP[parts], axis=1, dtype=np.uint8).astype(np.int64)
    byte = (upto <= rank[:, None]).sum(axis=1)
    rows = np.arange(len(words))
    own = parts[rows, byte]
    return byte * 8 + _AT[own, rank - upto[rows, byte] + _POP[own]]


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, and a spare word."""
    rows = -(-len(values) // 64)
    words = np.zeros((rows, width), np.uint64)  # 64 values take ``width`` words
    held = np.zeros(rows * 64, np.uint64)
    held[: len(values)] = values & np.uint64((1 << width) - 1)
    held = held.reshape(rows, 64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        words[:, word] |= held[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= held[:, j] >> np.uint64(64 - shift)
    return np.append(words.ravel(), np.uint64(0))


def pack(values: np.ndarray, universe: int, searched: bool = False) -> dict[str, np.ndarray]:
    """Arrays of the sequence ``values`` (sorted, each below ``universe``); ``find`` needs ``searched``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    width = min(WIDEST, max(0, (int(universe) // max(1, n)).bit_length() - 1) + 3 * searched)
    high = (values >> np.uint64(width)).astype(np.int64)
    steps = (int(universe) >> width) + 1
    ones = np.zeros((n + steps + 64) // 64 * 64, np.uint8)
    ones[high + np.arange(n)] = 1
    unary = np.packbits(ones, bitorder="little").view(np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(unary), dtype=np.int64)])
    out = {"low": _pack_low(values, width), "unary": unary, "ranks": ranks.astype(np.uint32), "shape": np.array([n, width], np.int64)}
    if searched:
        out["starts"] = np.concatenate([[0], np.cumsum(np.bincount(high, minlength=steps))]).astype(np.uint32)
    return out


class Sequence:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.unary, self.ranks, self.starts = parts["low"], parts["unary"], parts["ranks"], parts.get("starts")
        self.n, self.width = (int(x) for x in parts["shape"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ranks, i.astype(np.uint32), side="right") - 1
        place = word * 64 + _in_word(self.unary[word], i - self.ranks[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def range(self, first: int, stop: int) -> np.ndarray:
        """The numbers from the first-th on, up to the stop-th, unpacked together."""
        if first >= stop:
            return np.zeros(0, np.uint64)
        a = int(np.searchsorted(self.ranks, np.uint32(first), side="right")) - 1
        z = int(np.searchsorted(self.ranks, np.uint32(stop - 1), side="right"))
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.unary[a:z]).view(np.uint8), bitorder="little"))
        skip, i = first - int(self.ranks[a]), np.arange(first, stop)
        high = ones[skip : skip + stop - first] + a * 64 - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each number in a sequence without repeats, or -1: the first number not below it is looked up and compared."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        inside = (high >= 0) & (high < len(self.starts) - 1)
        high = np.where(inside, high, 0)
        low, stop = self.starts[high].astype(np.int64), self.starts[high + 1].astype(np.int64)
        stop[~inside] = low[~inside]
        want, end = x & np.uint64((1 << self.width) - 1), stop.copy()
        while len(open_ := np.flatnonzero(low < end)):
            mid = (low[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_], end[open_] = np.where(less, mid + 1, low[open_]), np.where(less, end[open_], mid)
        at = np.flatnonzero(low < stop)
        at = at[self._low(low[at]) == want[at]]
        out[at] = low[at]
        return out
