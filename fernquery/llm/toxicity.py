"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are which character n-grams it holds, hashed into a table. A feature's
log-count ratio says how much more often toxic texts hold it than others; a logistic
regression is fitted on the features times their ratios, so that n-grams that tell
nothing weigh nothing. The two classes weigh the same, whatever their shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernquery.llm.learn import labelled_sample, minimise, sigmoid

#: n-gram lengths, bits of the feature table, labelled texts of each class to learn from (at most),
#: texts that must hold a feature, smoothing of the counts, and weight of the penalty.
ORDERS, BITS, MAX_ROWS, MIN_TEXTS, SMOOTH, PENALTY = (3, 4, 5, 6), 20, 3000, 4, 1.0, 0.3

#: Characters of a text that are looked at together, about.
_WINDOW = 1 << 17
_GAP = re.compile(r"\s")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def _codes(text: str, carried: int) -> Iterator[tuple[np.ndarray, int]]:
    """Character codes of a text, some at a time, and how many of them were there before: the last ``carried``.

    White space is one space; texts begin and end with one. Texts are cut at white space, so
    a long one takes no more room at a time than a short one.
    """
    held, at = np.array([32], np.uint32), 0
    while at < len(text):
        gap = _GAP.search(text, at + _WINDOW)
        stop = gap.start() if gap else len(text)
        words, at = text[at:stop].lower().split(), stop
        if words:
            new = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield np.concatenate([held, new]), len(held)
            held = np.concatenate([held, new[-carried:]])[-carried:]


def ngrams(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Table places of all n-grams of a text, repeats included, some at a time."""
    for codes, before in _codes(text, max(orders) - 1):
        out, h = [], codes * np.uint32(0x9E3779B1)
        for n in range(2, max(orders) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            if n in orders:
                new = h[max(0, before - n + 1) :]
                mix = (new ^ (new >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                out.append((mix ^ (mix >> np.uint32(13))) >> np.uint32(32 - bits))
        if out:
            yield np.concatenate(out)


def features(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Sorted distinct table places of a text's n-grams."""
    parts = [np.unique(p) for p in ngrams(text, orders, bits)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Learn from texts and 0/1 labels. Without labels of both kinds the score is their smoothed share; without any, 0."""
    labels = np.asarray(labels, dtype=np.float64)
    weights, positive = np.zeros(1 << BITS, np.float32), labels.sum()
    if len(labels) == 0:
        return Model(weights, -40.0)
    if positive in (0, len(labels)):
        return Model(weights, float(np.log((positive + 0.5) / (len(labels) - positive + 0.5))))
    sets = [features(t).astype(np.int32) for t in texts]
    held, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for s, y in zip(sets, labels):
        held[s] += 1
        toxic[s] += y
    ratio = np.log((toxic + SMOOTH) / (positive + 2 * SMOOTH)) - np.log((held - toxic + SMOOTH) / (len(labels) - positive + 2 * SMOOTH))
    known = np.flatnonzero(held >= MIN_TEXTS)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    for i, s in enumerate(sets):  # one text at a time, so that no two copies of all sets are held
        sets[i] = place[s][held[s] >= MIN_TEXTS]
    r, lengths = ratio[known], np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(ends[-1], np.int32)
    for i, s in enumerate(sets):
        flat[ends[i] : ends[i + 1]], sets[i] = s, None
    share = np.where(labels > 0, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive)))  # both classes weigh the same
    blocks = [(a, min(a + 256, len(labels))) for a in range(0, len(labels), 256)]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1] * r, x[-1]
        total, grad = 0.5 * PENALTY * float(x[:-1] @ x[:-1]) * len(labels) / 100, np.zeros_like(x)
        for a, z in blocks:
            part, own = flat[ends[a] : ends[z]], np.repeat(np.arange(z - a), lengths[a:z])
            margin = np.bincount(own, weights=w[part], minlength=z - a) + b
            total += float(share[a:z] @ np.logaddexp(0, np.where(labels[a:z] > 0, -margin, margin)))
            error = share[a:z] * (sigmoid(margin) - labels[a:z])
            grad[:-1] += np.bincount(part, weights=error[own], minlength=len(known))
            grad[-1] += error.sum()
        grad[:-1] = grad[:-1] * r + PENALTY * x[:-1] * len(labels) / 100
        return total, grad

    x = minimise(loss, np.zeros(len(known) + 1), 40)
    weights[known] = (x[:-1] * r).astype(np.float32)
    return Model(weights, float(x[-1]))


def score_all(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column: probability that a whole text is toxic.

    Null and empty texts hold one space and nothing else; they score by the bias alone.
    Equal texts score equally, whatever the rows' other columns are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        seen = np.zeros(1 << m.bits, dtype=bool)
        for t in texts:
            text = t.as_py() or ""
            if len(text) <= 1 << 11:
                own = features(text, m.orders, m.bits)
            else:
                for places in ngrams(text, m.orders, m.bits):
                    seen[places] = True
                own = np.flatnonzero(seen)
                seen[own] = False
            out.append(m.bias + float(m.weights[own].sum(dtype=np.float64)))
        return pa.array(sigmoid(np.array(out, dtype=np.float64)))

    return run(docs[text_col])


def learn(docs: DataFrame, labels: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled texts of each class, those for which ``train`` (a column of labels) holds.

    Rows of labels with a null id or label are left out; an id that is labelled twice counts once, with the
    larger label; every row of ``docs`` with a labelled id is learnt from, a null text as an empty one.
    Without labels, or with empty tables, all texts score alike: see ``fit``.
    """
    texts, y = labelled_sample(docs, labels.filter(train), id_col, text_col, label_col, max_rows)
    return fit(texts, y)
