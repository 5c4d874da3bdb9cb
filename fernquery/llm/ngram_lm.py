"""N-gram language model in an Elias-Fano trie, built and queried by shards.

Levels are monotone sequences. Level 1 holds the hashes of all words; the place of a
word is its id. Level 2 holds, for each word, the ids of its kept successors, and level
3, for each kept bigram, the successors given by their place among the successors of its
second word. A monotone pointer per context says where its successors begin; a lookup is
a successor search among them. Counts are kept exactly, as differences of a monotone
sequence. Probabilities and weights for backing off are quantised to one byte.

Every level is cut into shards by ranges of (context, item). A task gathers n-grams, sorts
and adds them up in runs, and hands on a run as one block of bytes per shard; a shard is built by
merging its blocks, in memory that depends on the shard's size alone. Where to cut the next
level is known from the counts of the level above: a shard covers contexts with about SHARD
occurrences together, and a context with more of them is cut by its items. Readers map
the files into memory.

Counts cover all training texts. N-grams of two and three words are kept if they occur
``min_count`` times or more; with 1, all are. A bigram can only do so if its words do, and a trigram only if
its bigrams do, so the levels already built leave out most candidates before a shuffle.
Smoothing is interpolated absolute discounting, down to add-one over words:
``p(w|h) = (c - D) / C(h) + b(h) p(w|h')``, where b(h) is the mass that the kept successors
of h leave; every distribution sums to 1 before quantising.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm import tokens
from fernquery.llm.common import fresh_path, stored
from fernquery.llm.elias_fano import Sequence, pack

MIN_COUNT, DISCOUNT = 2, 0.75
#: Occurrences that a shard stands for, about; log10 below which probabilities are not told apart.
SHARD, FLOOR = 1 << 20, -9.0
#: Bytes of text for each shard of level 1.
WORD_SHARD = 1 << 25
#: Fixed value: the hash of the end of a text.
END = np.uint64(1)
#: Codes of tokens that are in no n-gram that is kept.
RARE, UNKNOWN = -1, -2
#: N-grams that a task gathers before it hands them on; bytes of encoded texts that are looked up together.
_HELD, _LOOKUP = 1 << 20, 1 << 21
#: Items and shards that one number holds together: bits of the item.
_ITEM_BITS = 40


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 / FLOOR * 255), 0, 255).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (FLOOR / 255)


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of all tokens in order: the words of each text, then one end."""
    h, owner = tokens.spaced_words(texts)
    n = np.bincount(owner, minlength=len(texts))
    stop = np.cumsum(n) + np.arange(len(texts))
    out, who = np.full(len(h) + len(texts), END, np.uint64), np.zeros(len(h) + len(texts), np.int64)
    at = np.arange(len(h)) + owner
    out[at], who[at], who[stop] = h, owner, np.arange(len(texts))
    return out, who


def _fs(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write one file: how long the description is, what the arrays are and where, then the arrays."""
    store, base = _fs(folder)
    at, places = 0, {}
    for key, x in arrays.items():
        places[key] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    said = json.dumps(places).encode()
    said += b" " * (-len(said) % 8)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(len(said).to_bytes(8, "little") + said)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).view(np.uint8).tobytes() + b"\0" * (-x.nbytes % 8))


def _map(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; one in another store is copied first and unlinked once it is mapped."""
    store, base = _fs(folder)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(f"{base}/{name}", np.uint8, mode="r")
    else:
        with tempfile.NamedTemporaryFile(suffix=".level") as own, store.open_input_stream(f"{base}/{name}") as src:
            while part := src.read(1 << 22):
                own.write(part)
            own.flush()
            data = np.memmap(own.name, np.uint8, mode="r")
    start = 8 + int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for key, (kind, n, at) in json.loads(data[8:start].tobytes()).items():
        kind = np.dtype(kind)
        out[key] = np.asarray(data[start + at : start + at + n * kind.itemsize]).view(kind)
    return out


@dataclass
class Shard:
    """Where it begins (context and item, or hash), contexts it covers, place of its first entry, entries, its file."""

    first: int
    item: int
    contexts: int
    offset: int
    entries: int
    name: str


def _grouped(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(owner, which are its) of each owner from 0 on."""
    order = None
    if len(owner) and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner.astype(np.int16) if owner.max() < 1 << 15 else owner, kind="stable")
        owner = owner[order]
    cut = [0, *(1 + np.flatnonzero(owner[1:] != owner[:-1])).tolist(), len(owner)]
    for a, z in zip(cut, cut[1:]):
        if a < z and owner[a] >= 0:
            yield int(owner[a]), slice(a, z) if order is None else order[a:z]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and for each pair which of them it is."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    if a.max() < 1 << 31 and b.max() < 1 << 32:
        k, back = np.unique(a << 32 | b, return_inverse=True)
        return k >> 32, k & 0xFFFFFFFF, back
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], y[new], back


class Level:
    """The shards of one level."""

    def __init__(self, folder: str, number: int, shards: list[Shard]):
        self.folder, self.number, self.shards = folder, number, shards
        self.offsets = np.array([s.offset for s in shards], np.int64)
        self.firsts = np.array([s.first for s in shards], np.uint64)
        self.contexts, which = np.unique(self.firsts, return_inverse=True)
        self.keys = which.astype(np.int64) << _ITEM_BITS | (np.array([s.item for s in shards], np.int64) + 1)
        self._open: dict[int, dict] = {}

    def _part(self, k: int, part: str):
        if k not in self._open:
            arrays = _map(self.folder, self.shards[k].name)
            own = {p: {x.removeprefix(f"{p}_"): v for x, v in arrays.items() if x.startswith(f"{p}_")} for p in ("items", "counts", "pointers")}
            self._open[k] = {**{p: Sequence(x) for p, x in own.items() if x}, **{x: v for x, v in arrays.items() if "_" not in x}}
        return self._open[k][part]

    def _by_key(self, context: np.ndarray, item: np.ndarray | int) -> np.ndarray:
        """The last shard that begins at or before each (context, item), or -1."""
        u = np.searchsorted(self.contexts, context.astype(np.uint64), side="right") - 1
        if len(self.contexts) == len(self.shards) and isinstance(item, np.ndarray):
            return u  # no context is cut: items of the first context of a shard are not below its own
        same = (u >= 0) & (self.contexts[np.maximum(u, 0)] == context.astype(np.uint64))
        key = np.maximum(u, -1) << _ITEM_BITS | np.where(same, item + 1, (1 << _ITEM_BITS) - 1)
        return np.searchsorted(self.keys, key, side="right") - 1

    def _by_place(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1

    def find(self, context: np.ndarray, item: np.ndarray | None = None) -> np.ndarray:
        """Places of the items among the successors of their contexts, or -1. On level 1 the context is the hash."""
        out = np.full(len(context), -1, np.int64)
        owner = np.searchsorted(self.firsts, context, side="right") - 1 if item is None else self._by_key(context, item)
        for k, at in _grouped(owner):
            s = self.shards[k]
            if item is None:
                got = self._part(k, "items").find(context[at] - np.uint64(s.first))
            else:
                width = int(self._part(k, "width")[0])
                c, i = context[at].astype(np.int64) - s.first, item[at]
                able = (c >= 0) & (c < s.contexts) & (i < width)
                got = np.where(able, self._part(k, "items").find(np.where(able, c * width + i, 0).astype(np.uint64)), -1)
            out[at] = np.where(got >= 0, got + s.offset, -1)
        return out

    def _over(self, first: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(shard, first, stop) of the shards' own entries among the places from first to stop."""
        for k in range(max(0, int(self._by_place(np.array([first]))[0])), len(self.shards)):
            s = self.shards[k]
            if s.offset >= stop:
                break
            a, z = max(first, s.offset) - s.offset, min(stop - s.offset, s.entries)
            if a < z:
                yield k, a, z

    def items(self, first: int, stop: int) -> np.ndarray:
        """The items at consecutive places."""
        parts = [(self._part(k, "items").range(a, z) % np.uint64(self._part(k, "width")[0])).astype(np.int64) for k, a, z in self._over(first, stop)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def counts(self, first: int, stop: int) -> np.ndarray:
        """The counts at consecutive places."""
        parts = [np.diff(self._part(k, "counts").range(a, z + 1).astype(np.int64)) for k, a, z in self._over(first, stop)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def begin(self, context: np.ndarray) -> np.ndarray:
        """The pointers: place of the first successor of each context."""
        out = np.zeros(len(context), np.int64)
        for k, at in _grouped(self._by_key(context, -1)):
            s = self.shards[k]
            own = np.clip(context[at].astype(np.int64) - s.first, 0, s.contexts)
            out[at] = self._part(k, "pointers").get(own).astype(np.int64) + s.offset
        return out

    def count(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for k, at in _grouped(self._by_place(place)):
            i, total = place[at] - self.shards[k].offset, self._part(k, "counts")
            out[at] = (total.get(i + 1) - total.get(i)).astype(np.int64)
        return out

    def p_codes(self, place: np.ndarray) -> np.ndarray:
        """Quantised probabilities at places."""
        out = np.zeros(len(place), np.uint8)
        for k, at in _grouped(self._by_place(place)):
            out[at] = self._part(k, "p")[place[at] - self.shards[k].offset]
        return out

    def log_backoff(self, context: np.ndarray) -> np.ndarray:
        """Weight for backing off from each context; 0 where it has no kept successor."""
        out = np.zeros(len(context))
        for k, at in _grouped(self._by_key(context, (1 << _ITEM_BITS) - 2)):
            s = self.shards[k]
            own = context[at].astype(np.int64) - s.first
            inside = (own >= 0) & (own < s.contexts)
            out[at] = np.where(inside, restore(self._part(k, "b")[np.where(inside, own, 0)]), 0.0)
        return out


@dataclass
class Model:
    """What tasks need to open a model: its folder and the shards of its levels."""

    folder: str
    tokens: int
    words: int
    shards: dict[int, list[Shard]]
    min_count: int = MIN_COUNT
    shard: int = SHARD

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("folder", "tokens", "words", "shards", "min_count", "shard")}

    @cached_property
    def level1(self) -> Level:
        return Level(self.folder, 1, self.shards[1])

    @cached_property
    def level2(self) -> Level:
        return Level(self.folder, 2, self.shards[2])

    @cached_property
    def level3(self) -> Level:
        return Level(self.folder, 3, self.shards[3])

    def with_level(self, number: int, shards: list[Shard]) -> Model:
        return Model(self.folder, self.tokens, self.words, {**self.shards, number: shards}, self.min_count, self.shard)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by hash."""
        own, back = np.unique(h, return_inverse=True)
        found = self.level1.find(own)
        count = np.zeros(len(own), np.int64)
        count[found >= 0] = self.level1.count(found[found >= 0])
        return found[back], count[back]

    @property
    def kind(self) -> str:
        """How encoded tokens are stored."""
        return "<i4" if self.words < 1 << 31 else "<i8"

    def p_word(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)

    def log_word(self, count: np.ndarray) -> np.ndarray:
        return np.log10(self.p_word(count))

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: its tokens' codes, how many tokens, how many are known, and the add-one log10 probability.

        The code of a word is its id, or RARE if it occurs too seldom to be in an n-gram
        that is kept, or UNKNOWN.
        """
        h, owner = text_tokens(texts)
        word, count = self.ids(h)
        codes = np.where(count >= self.min_count, word, np.where(count > 0, RARE, UNKNOWN)).astype(self.kind)
        n = np.bincount(owner, minlength=len(texts))
        known = np.bincount(owner, weights=count > 0, minlength=len(texts)).astype(np.int64)
        base = np.bincount(owner, weights=self.log_word(count), minlength=len(texts))
        return [x.tobytes() for x in np.split(codes, np.cumsum(n)[:-1])] if len(texts) else [], n, known, base

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, number of the text) of all tokens of encoded texts."""
        codes = np.frombuffer(b"".join(texts), self.kind).astype(np.int64)
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts)) // np.dtype(self.kind).itemsize
        return codes, np.repeat(np.arange(len(texts)), n)

    def bigrams(self, code: np.ndarray, owner: np.ndarray, ranked: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Place of the bigram that ends at each token, or -1, and, if asked, its place among the successors of its first word."""
        out, rank = np.full(len(code), -1, np.int64), np.zeros(len(code) if ranked else 0, np.int64)
        at = 1 + np.flatnonzero((owner[1:] == owner[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
        a, b, back = _distinct(code[at - 1], code[at])
        place = self.level2.find(a, b)
        out[at] = place[back]
        if ranked and len(a):
            new = np.concatenate([[True], a[1:] != a[:-1]])
            rank[at] = (place - self.level2.begin(a[new])[np.cumsum(new) - 1])[back]
        return out, rank

    def gains(self, texts: list[bytes]) -> np.ndarray:
        """Per encoded text: log10 probability of the model less that of add-one."""
        code, owner = self.decode(texts)
        two, rank = self.bigrams(code, owner, ranked=True)
        gain = np.zeros(len(code))
        seen = np.flatnonzero(two >= 0)
        own, back = np.unique(code[seen], return_inverse=True)
        base = self.log_word(self.level1.count(own))[back]
        told = restore(self.level2.p_codes(two[seen]))
        unseen = 1 + np.flatnonzero((owner[1:] == owner[:-1]) & (code[:-1] >= 0) & (two[1:] < 0))
        gain[unseen] = self.level2.log_backoff(code[unseen - 1])
        able = np.flatnonzero(two[seen - 1] >= 0)  # a bigram ends at the token before; it is of the same text
        at = seen[able]
        a, b, back = _distinct(two[at - 1], rank[at])
        place = self.level3.find(a, b)
        met = place >= 0
        p = np.zeros(len(a))
        p[met] = restore(self.level3.p_codes(place[met]))
        p[~met] = self.level3.log_backoff(a[~met])
        told[able] = np.where(met[back], p[back], told[able] + p[back])
        gain[seen] = told - base
        lone = 1 + np.flatnonzero((two[:-1] >= 0) & (owner[1:] == owner[:-1]) & (two[1:] < 0))
        gain[lone] += self.level3.log_backoff(two[lone - 1])
        return np.bincount(owner, weights=gain, minlength=len(texts))


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Numbers as their lowest bytes, then the next, as many as the largest needs: much the same bytes stand together."""
    x = np.ascontiguousarray(x).view(np.uint64)
    n = max(1, (int(x.max()).bit_length() + 7) // 8)
    return n, np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _block(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Bytes of a sorted run of (context, item, count)."""
    parts = [_planes(np.diff(a, prepend=a.dtype.type(0))), _planes(b), _planes(c)]
    return np.array([len(a), *(n for n, _ in parts)], "<i8").tobytes() + b"".join(x for _, x in parts)


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, *planes = np.frombuffer(block, "<i8", 4).tolist()
    out, at = [], 32
    for p in planes:
        x = np.zeros((n, 8), np.uint8)
        x[:, :p] = np.frombuffer(block, np.uint8, n * p, at).reshape(p, n).T
        out.append(x.reshape(-1).view(np.int64))
        at += n * p
    return np.cumsum(out[0].view(np.uint64)).view(np.int64), out[1], out[2]


def _run(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (context, item) with the sums of their counts, each 1 where none are given. Contexts sort as unsigned numbers."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    packed = 0 <= a.min() and a.max() < 1 << 31 and b.max() < 1 << 32
    order = None
    if packed and c is None:
        k = np.sort(a << 32 | b)
    elif packed:
        k = a << 32 | b
        order = np.argsort(k, kind="stable")  # blocks are sorted runs, which this merges
        k = k[order]
    elif b.any():
        order = np.lexsort((b, a.view(np.uint64)))
    else:
        order = np.argsort(a.view(np.uint64), kind="stable")
    if packed:
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        a, b, n = k[first] >> 32, k[first] & 0xFFFFFFFF, len(k)
    else:
        a, b, n = a[order], b[order], len(a)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b = a[first], b[first]
    return a, b, np.diff(np.append(first, n)) if c is None else np.add.reduceat(c[order], first)


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return held[0] if len(held) == 1 else _run(*(np.concatenate(x) for x in zip(*held)))


@dataclass
class Cuts:
    """Where the shards of a level begin: contexts (hashes on level 1) and items; for an item also its place among the successors; shards that hold a part of one context."""

    context: np.ndarray
    item: np.ndarray
    rank: np.ndarray
    split: np.ndarray

    def blocks(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[list[int], list[bytes]]:
        """A sorted run as one block for each shard that it has a part in."""
        own = a.view(np.uint64)
        at = np.searchsorted(own, self.context, side="left")
        for k in np.flatnonzero(self.item > 0):
            stop = np.searchsorted(own, self.context[k], side="right")
            at[k] += np.searchsorted(b[at[k] : stop], self.item[k])
        at = np.append(at, len(a)).tolist()
        met = [k for k in range(len(self.context)) if at[k] < at[k + 1]]
        return met, [_block(a[at[k] : at[k + 1]], b[at[k] : at[k + 1]], c[at[k] : at[k + 1]]) for k in met]


_MADE = "bucket int, name string, contexts long, entries long, mass double, total long, cuts array<long>, hot array<long>, hot_counts array<long>"


def _gather(texts: DataFrame, grams: Callable, cuts: Cuts, size: int) -> DataFrame:
    """``(bucket, block)``: the n-grams that ``grams(texts)`` yields, sorted and added up in runs, a block for each shard."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
    shared = texts.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        held, n = [], 0

        def handed():
            met, blocks = shared.value.blocks(*_run(*(np.concatenate(x) for x in zip(*held))))
            return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(blocks, pa.binary())], schema=schema)

        for batch in batches:
            for part in tokens.chunks([t or b"" for t in batch[0].to_pylist()], limit=size):
                held.append(grams(part))
                n += len(held[-1][0])
                if n >= _HELD:
                    yield handed()
                    held, n = [], 0
        if n:
            yield handed()

    return texts.mapInArrow(run, "bucket int, block binary")


def _build(blocks: DataFrame, model: Model, number: int, cuts: Cuts) -> tuple[list[Shard], Cuts]:
    """Merge the blocks of each shard and write it; the shards of the level, and the cuts of the next."""
    shared = blocks.sparkSession.sparkContext.broadcast((model, cuts))
    parts = len(cuts.context)

    def run(batches):
        current, held, n, most = None, [], 0, 0
        for batch in batches:
            for bucket, block in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if bucket != current:
                    if held:
                        yield row(current, held)
                    current, held, n, most = bucket, [], 0, 2 * _HELD
                held.append(_unblock(block))
                n += len(held[-1][0])
                if n > most:
                    held = [_merged(held)]
                    n = len(held[0][0])
                    most = max(2 * _HELD, 2 * n)
        if held:
            yield row(current, held)

    def row(bucket, held):
        model, cuts = shared.value
        return pa.RecordBatch.from_pylist([_shard(model, number, bucket, cuts, *_merged(held))], schema=made_schema)

    lists = pa.list_(pa.int64())
    made_schema = pa.schema([("bucket", pa.int32()), ("name", pa.string()), ("contexts", pa.int64()), ("entries", pa.int64()), ("mass", pa.float64()), ("total", pa.int64()), ("cuts", lists), ("hot", lists), ("hot_counts", lists)])
    made = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _MADE).collect()
    made = sorted((r for r in made if r["entries"]), key=lambda r: r["bucket"])
    shards, offset, following = [], 0, []
    for r in made:
        k = r["bucket"]
        shards.append(Shard(int(cuts.context[k]), int(cuts.rank[k]), r["contexts"], offset, r["entries"], r["name"]))
        hot = dict(zip(r["hot"], r["hot_counts"]))
        following += [(offset + x, hot.get(x, 0)) for x in r["cuts"]]
        offset += r["entries"]
    split = [k for k, r in enumerate(made) if cuts.split[r["bucket"]]]
    if split:
        mass: dict[int, float] = {}
        for k in split:
            mass[shards[k].first] = mass.get(shards[k].first, 0.0) + made[k]["mass"]
        jobs = [(k, mass[shards[k].first]) for k in split]
        for k, name in _smoothed(blocks.sparkSession, model, number, shards, jobs):
            shards[k].name = name
    return shards, _cuts(model.with_level(number, shards), number, following)


def _shard(model: Model, number: int, bucket: int, cuts: Cuts, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> dict:
    """Write one shard from its merged n-grams, smoothed unless it is a part of one context; what the driver needs of it."""
    kept = c >= model.min_count if number > 1 else slice(None)
    a, b, c = a[kept], b[kept], c[kept]
    out = {"bucket": bucket, "name": f"level{number}-{bucket}-{uuid.uuid4().hex}", "contexts": 0, "entries": len(a), "mass": 0.0, "total": int(c.sum()), "cuts": [], "hot": [], "hot_counts": []}
    if not len(a):
        return out
    total = np.concatenate([[0], np.cumsum(c)])
    arrays = {f"counts_{k}": v for k, v in pack(total, int(total[-1]) + 1).items()}
    if number == 1:
        h = a.view(np.uint64) - cuts.context[bucket]
        out["contexts"] = len(a)
        arrays |= {f"items_{k}": v for k, v in pack(h, int(h[-1]) + 1, searched=True).items()}
    else:
        first = int(cuts.context[bucket])
        own = a - first
        contexts = out["contexts"] = int(own[-1]) + 1
        item = b
        if number == 3:  # what follows a bigram is told by its place among the successors of the bigram's second word
            word, back = np.unique(model.level2.items(first, first + contexts), return_inverse=True)
            item = b - model.level2.begin(word)[back][own]
        width = int(item.max()) + 1
        arrays |= {f"items_{k}": v for k, v in pack((own * width + item).astype(np.uint64), contexts * width, searched=True).items()} | {"width": np.array([width], np.int64)}
        arrays |= {f"pointers_{k}": v for k, v in pack(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=contexts))]), len(a) + 1).items()}
        whole = _whole(model, number, first, contexts)
        mass = np.bincount(own, weights=c - DISCOUNT, minlength=contexts)
        out["mass"] = float(mass.sum())
        arrays |= {"b": np.zeros(1, np.uint8), "p": np.zeros(0, np.uint8)} if cuts.split[bucket] else _smooth(model, number, own, b, c, whole, mass)
    if number < 3:
        hot = np.flatnonzero(c > model.shard)
        at = np.unique(np.concatenate([[0], np.searchsorted(total[1:], np.arange(model.shard, int(total[-1]), model.shard)), hot, hot + 1]))
        out |= {"cuts": at[at < len(a)].tolist(), "hot": hot.tolist(), "hot_counts": c[hot].tolist()}
    _save(model.folder, out["name"], arrays)
    return out


def _whole(model: Model, number: int, first: int, contexts: int) -> np.ndarray:
    """How often each of consecutive contexts occurs."""
    return (model.level1 if number == 2 else model.level2).counts(first, first + contexts)


def _smooth(model: Model, number: int, own: np.ndarray, b: np.ndarray, c: np.ndarray, whole: np.ndarray, mass: np.ndarray) -> dict[str, np.ndarray]:
    """Quantised probabilities of the entries and weights of the contexts. b: word ids on level 2, places of bigrams on level 3."""
    left = np.clip(1 - mass / whole, 1e-9, 1)
    if number == 2:
        word, back = np.unique(b, return_inverse=True)
        lower = model.p_word(model.level1.count(word))[back]
    else:
        lower = (10 ** restore(np.arange(256)))[model.level2.p_codes(b)]
    return {"p": quantise(np.log10((c - DISCOUNT) / whole[own] + left[own] * lower)), "b": quantise(np.log10(left))}


def _smoothed(spark, model: Model, number: int, shards: list[Shard], jobs: list[tuple[int, float]]) -> list[tuple[int, str]]:
    """Write the shards that hold a part of one context again, with the mass that all its parts have."""
    at_hand = spark.createDataFrame([(k, mass) for k, mass in jobs], "k int, mass double").repartition(min(len(jobs), 1000))
    shared = spark.sparkContext.broadcast((model, {k: shards[k] for k, _ in jobs}))

    def run(batches):
        model, own = shared.value
        for batch in batches:
            for k, mass in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                s = own[k]
                arrays = _map(model.folder, s.name)
                part = {p: Sequence({x.removeprefix(f"{p}_"): v for x, v in arrays.items() if x.startswith(f"{p}_")}) for p in ("items", "counts")}
                item, c = part["items"].range(0, s.entries).astype(np.int64), np.diff(part["counts"].range(0, s.entries + 1).astype(np.int64))
                b = item if number == 2 else item + model.level2.begin(model.level2.items(s.first, s.first + 1))
                arrays |= _smooth(model, number, np.zeros(s.entries, np.int64), b, c, _whole(model, number, s.first, 1), np.array([mass]))
                name = f"level{number}-part-{uuid.uuid4().hex}"
                _save(model.folder, name, arrays)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "name": [name]})

    return [(r["k"], r["name"]) for r in at_hand.mapInArrow(run, "k int, name string").collect()]


def _cuts(model: Model, number: int, following: list[tuple[int, int]]) -> Cuts:
    """The cuts of the level above ``number``: contexts, and items for those that occur more often than SHARD."""
    context, item, rank, split = [], [], [], []
    words = sum(s.entries for s in model.shards[1])
    for place, count in following:
        start, successors = 0, words
        if count and number == 2:
            word = model.level2.items(place, place + 1)
            start, stop = model.level2.begin(np.concatenate([word, word + 1])).tolist()
            successors = stop - start
        n = max(1, -(-min(count, successors) // model.shard))
        for j in range(n):
            r = successors * j // n
            context.append(place), item.append(r + start if j else 0), rank.append(r if j else 0), split.append(n > 1)
    if not context:
        context, item, rank, split = [0], [0], [0], [False]
    return Cuts(np.array(context, np.uint64), np.array(item, np.int64), np.array(rank, np.int64), np.array(split, bool))


def vocabulary(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT, shard: int = SHARD) -> tuple[Model, Cuts]:
    """A model of level 1 from all texts of ``docs``, and the cuts of level 2; null texts are empty. Without texts every token is unknown."""
    model = Model(fresh_path(docs.sparkSession, "lm"), 0, 0, {1: [], 2: [], 3: []}, min_count, shard)
    store, base = _fs(model.folder)
    store.create_dir(base, recursive=True)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // WORD_SHARD))
    cuts = Cuts(np.array([(k << 64) // n for k in range(n)], np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool))

    def words(part):
        h, _ = text_tokens(part)
        return h.view(np.int64), np.zeros(len(h), np.int64)

    shards, following = _build(_gather(texts, words, cuts, tokens.CHUNK), model, 1, cuts)
    model.words = sum(s.entries for s in shards)
    model = model.with_level(1, shards)
    model.tokens = sum(int(model.level1._part(k, "counts").get(np.array([s.entries]))[0]) for k, s in enumerate(shards))
    return model, following


def encoded(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct column ``(codes, n_tokens, n_known, base_score)`` of whole texts; a null or empty text has the end alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<codes:binary,n_tokens:bigint,n_known:bigint,base_score:double>")
    def run(texts: pa.Array) -> pa.Array:
        codes, rest = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for part in tokens.chunks([t or b"" for t in texts.to_pylist()]):
            own, *numbers = shared.value.encode(part)
            codes += own
            rest.append(numbers)
        n, known, base = (np.concatenate(x) for x in zip(*rest))
        return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())], ["codes", "n_tokens", "n_known", "base_score"])

    return run(F.col(text_col).cast("binary"))


def train(texts: DataFrame, model: Model, cuts: Cuts, codes_col: str = "codes") -> Model:
    """Levels 2 and 3 from encoded texts, those that level 1 was made from; ``cuts`` are level 2's."""

    for number in (2, 3):
        if not model.shards[number - 1]:
            break
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def pairs(part):
            code, owner = shared.value.decode(part)
            at = np.flatnonzero((owner[1:] == owner[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
            return code[at], code[at + 1]

        def triples(part):
            code, owner = shared.value.decode(part)
            two, _ = shared.value.bigrams(code, owner)
            at = np.flatnonzero((two[1:] >= 0) & (two[:-1] >= 0))  # both are of the same text: a text's first token ends no bigram
            return two[at], two[at + 1]

        shards, cuts = _build(_gather(texts.select(codes_col), pairs if number == 2 else triples, cuts, _LOOKUP), model, number, cuts)
        model = model.with_level(number, shards)
    return model


def score(texts: DataFrame, model: Model, codes_col: str = "codes", base_col: str = "base_score") -> Column:
    """Column: log10 probability of whole encoded texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(codes: pa.Array) -> pa.Array:
        parts = [shared.value.gains(p) for p in tokens.chunks(codes.to_pylist(), limit=_LOOKUP)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.col(base_col) + run(F.col(codes_col))


def train_and_score(docs: DataFrame, train_on: Column, *, text_col: str = "text", min_count: int = MIN_COUNT, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """A model of the rows for which ``train_on`` holds, and all rows with ``n_tokens, n_known, base_score, score`` in place of the text.

    A null text has the end as its only token; repeated rows count as often as they are
    there. Input columns that have the name of a new one are left out. ``shard`` is how many
    occurrences a shard stands for, about; scores don't depend on it.
    """
    marked = docs.withColumn("_train", train_on)
    model, cuts = vocabulary(marked.filter("_train"), text_col, min_count, shard)
    rest = [c for c in docs.columns if c not in (text_col, "_train", "_e", "codes", "n_tokens", "n_known", "base_score", "score")]
    texts = stored(marked.select(*rest, "_train", encoded(marked, model, text_col).alias("_e")).select(*rest, "_train", "_e.*"), "encoded")
    model = train(texts.filter("_train"), model, cuts)
    return model, texts.withColumn("score", score(texts, model)).drop("codes", "_train")
