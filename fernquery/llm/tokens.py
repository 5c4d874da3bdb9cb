"""Tokens of many texts at once, as NumPy arrays: where they are and their 64-bit hashes.

A token's hash is a sum of per-character constants times powers of an odd number,
modulo 2**64, so the hashes of all tokens come from one running sum over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters that one array holds, at least; a longer text makes a longer array.
CHUNK = 1 << 19


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_STEP, _BACK):
        p = np.full(1 << bits, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of maximal runs of one non-zero kind."""
    edge = np.flatnonzero(np.diff(kinds, prepend=np.uint8(0), append=np.uint8(0)))
    at = kinds[edge[:-1]] if len(edge) else np.zeros(0, np.uint8)
    keep = at != 0
    return edge[:-1][keep], edge[1:][keep]


def hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:stop]``; values are per-character constants (uint64)."""
    up, down = _powers(max(10, int(len(values)).bit_length()))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts])


def chunks(texts: list, size=len, limit: int | None = None) -> Iterator[list]:
    """Consecutive texts of about CHUNK characters together, or of ``limit``, one text at least."""
    limit = limit or CHUNK
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += size(t)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


@cache
def _kinds() -> np.ndarray:
    """Of each character of the basic plane: 0 white space, 1 in words, 2 other."""
    out = np.full(0x10001, 1, dtype=np.uint8)
    for c in range(0x10000):
        x = chr(c)
        out[c] = 0 if x.isspace() else 1 if x.isalnum() or x == "_" else 2
    return out


def word_and_sign_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of its text): runs of letters and digits, and runs of other signs; case is kept."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts, stops = runs(_kinds()[np.minimum(codes, 0x10000)])
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), starts, stops), owner


@cache
def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: 1 where it is part of a word (not white space), and its constant, A-Z as a-z."""
    kind, value = np.ones(256, np.uint8), np.arange(1, 257, dtype=np.uint64)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    value[0x41:0x5B] = value[0x61:0x7B]
    return kind, mixed(value * np.uint64(0xD1342543DE82EF95))


def spaced_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text): runs of bytes other than white space, A-Z lower-cased.

    The bytes are read in windows that end at white space, so a long text takes no more
    room at a time than a short one; a single word longer than a window does.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind, value = _byte_table()
    begun, found, at = [], [], 0
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        while stop < len(data) and kind[data[stop - 1]]:
            gap = np.flatnonzero(kind[data[stop : stop + CHUNK]] == 0)
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + CHUNK, len(data))
        own = data[at:stop]
        starts, stops = runs(kind[own])
        begun.append(starts + at)
        found.append(hashes(value[own], starts, stops))
        at = stop
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return np.concatenate(found), np.searchsorted(ends, np.concatenate(begun), side="right")
