"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing gives each word a sparse random index vector and adds, to the context
vector of each word, the index vectors of the words around it, over the whole corpus.
Words are hashed into a table of fixed size, so the matrix is bounded whatever the
vocabulary, each task adds up its own and only non-empty blocks of it are moved. A
document is the mean and the spread of its words' vectors; a two-layer network in NumPy
scores it, and a temperature fitted on rows apart makes its scores probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm import tokens
from fernquery.llm.learn import sampled_labels, sigmoid

#: Bits of the word table, width of the vectors, neighbours on each side, ones in an index vector.
BITS, WIDTH, REACH, ONES = 14, 32, 2, 2
#: Rows of the matrix that are moved together.
BLOCK = 256
#: Labelled texts of each class to learn from, at most; units, rounds over the rows, and share of rows for the temperature.
MAX_ROWS, HIDDEN, ROUNDS, APART = 5000, 24, 60, 0.2
_BATCH = 128


def index_places(count: int = 1 << BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the ONES non-zero elements of each word's index vector."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, WIDTH, (count, ONES)), rng.choice([-1.0, 1.0], (count, ONES))


def add_contexts(total: np.ndarray, texts: list[str]) -> None:
    """Add the contexts of the texts' words to ``total``, a flat (word, element) matrix."""
    places, signs = index_places()
    for part in tokens.chunks(texts):
        h, owner = tokens.word_and_sign_tokens(part)
        word = (h >> np.uint64(64 - BITS)).astype(np.int64)
        for d in range(1, REACH + 1):
            near = owner[d:] == owner[:-d]
            left, right = word[:-d][near], word[d:][near]
            for a, b in ((left, right), (right, left)):
                for k in range(ONES):
                    total += np.bincount(a * WIDTH + places[b, k], weights=signs[b, k], minlength=len(total))


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of the word table over all documents, scaled to length 1; (2**BITS, WIDTH)."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def gather(batches):
        total = np.zeros(WIDTH << BITS)
        for batch in batches:
            add_contexts(total, [t or "" for t in batch[0].to_pylist()])
        yield from rows({b: x for b, x in enumerate(total.reshape(-1, BLOCK * WIDTH)) if x.any()})

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                total[b] = total.get(b, 0) + np.frombuffer(x, "<f4").astype(np.float64)
        yield from rows(total)

    def rows(total):
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], schema=schema)

    parts = docs.select(text_col).mapInArrow(gather, "block int, sums binary")
    merged = parts.repartition(8, "block").mapInArrow(merge, "block int, sums binary").collect()
    out = np.zeros(((1 << BITS) // BLOCK, BLOCK * WIDTH))
    for r in merged:
        out[r["block"]] = np.frombuffer(r["sums"], "<f4")
    out = out.reshape(-1, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, the mean's length, and how alike neighbours are. A text without words is all zeros."""
    out = np.zeros((len(texts), 2 * WIDTH + 2), np.float32)
    at = 0
    for part in tokens.chunks(texts):
        h, owner = tokens.word_and_sign_tokens(part)
        if len(h):
            v = vectors[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            n = np.diff(np.append(first, len(owner)))[:, None].astype(np.float32)
            mean = np.add.reduceat(v, first, axis=0) / n
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / n - mean * mean, 0))
            alike = np.append((v[1:] * v[:-1]).sum(axis=1) * (owner[1:] == owner[:-1]), np.float32(0))
            own = owner[first] + at
            out[own, :WIDTH], out[own, WIDTH : 2 * WIDTH] = mean, spread
            out[own, -2], out[own, -1] = np.linalg.norm(mean, axis=1), np.add.reduceat(alike, first) / n[:, 0]
        at += len(part)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.centre) / self.scale @ a + b, 0) @ c + d[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.margins(pool(texts, self.vectors).astype(np.float64)) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """Two layers by Adam, both classes weighing the same, then the temperature.

    Without labels of both kinds the score is their smoothed share; without any, 0.
    """
    width, y = 2 * WIDTH + 2, np.asarray(y, np.float64)
    flat = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([-40.0])]
    if len(y) == 0 or y.min() == y.max():
        if len(y):
            flat[3][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return Model(vectors, np.zeros(width), np.ones(width), flat)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart, own = order[: int(APART * len(y))], order[int(APART * len(y)) :]
    x = x.astype(np.float64)
    model = Model(vectors, x[own].mean(axis=0), x[own].std(axis=0) + 1e-3, [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)])
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    z = (x - model.centre) / model.scale
    moments, t = [(np.zeros_like(p), np.zeros_like(p)) for p in model.layers], 0
    for _ in range(ROUNDS):
        for ids in np.array_split(rng.permutation(own), max(1, len(own) // _BATCH)):
            a, b, c, d = model.layers
            hidden = np.maximum(z[ids] @ a + b, 0)
            error = share[ids] * (sigmoid(hidden @ c + d[0]) - y[ids]) / len(ids)
            back = np.outer(error, c) * (hidden > 0)
            grads = [z[ids].T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error + 1e-4 * c, np.array([error.sum()])]
            t += 1
            for p, g, (m, v) in zip(model.layers, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if len(apart):
        margin = model.margins(x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [float((share[apart] * np.logaddexp(0, np.where(y[apart] > 0, -margin, margin) / s)).sum()) for s in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Word vectors from all documents; the network from at most ``max_rows`` labelled texts of each class, those for which ``train`` (a column of labels) holds.

    Rows of labels with a null id or label are left out; an id that is labelled twice counts once, with the
    larger label; every row of ``docs`` with a labelled id is learnt from, a null text as one without words.
    Without labels, or with empty tables, all texts score alike: see ``fit``.
    """
    vectors = context_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in pool([t or "" for t in texts.to_pylist()], shared.value)], pa.binary())

    chosen = sampled_labels(labels.filter(train), id_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("l_id")).select("_id", "y", features("_text").alias("x")).collect()
    rows = sorted(rows, key=lambda r: (r["_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * WIDTH + 2)
    return fit(x, np.array([r["y"] for r in rows]), vectors)


def score_all(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column: probability of quality label 1 of a whole text; null and empty texts score like a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([t or "" for t in texts.to_pylist()]), pa.float64())

    return run(docs[text_col])
