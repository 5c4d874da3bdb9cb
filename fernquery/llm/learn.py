"""What the trained operators share: samples of labelled rows, and a minimiser."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``(id, y)`` of at most ``max_rows`` labelled ids of each class, the first in an order that depends on the id alone.

    Null ids and labels are left out; an id that is labelled twice counts once, with the larger label.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    order = (F.xxhash64("l_id"), F.col("l_id"))
    return rows.filter("y = 1").orderBy(*order).limit(max_rows).unionByName(rows.filter("y = 0").orderBy(*order).limit(max_rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded sample, on the driver."""
    chosen = sampled_labels(labels, id_col, label_col, max_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("l_id"))
    rows = found.select("_id", "_text", "y").toArrow()
    order = np.argsort(rows["_id"].to_numpy(), kind="stable")
    return [rows["_text"][int(i)].as_py() for i in order], rows["y"].to_numpy()[order]


def minimise(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving steps. ``loss(x)`` gives value and gradient."""
    value, grad = loss(x)
    steps: deque = deque(maxlen=memory)
    for _ in range(rounds):
        direction, stack = -grad, []
        for s, y, rho in reversed(steps):
            a = rho * (s @ direction)
            direction = direction - a * y
            stack.append(a)
        if steps:
            s, y, _ = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, float(np.abs(direction).sum()))
        for (s, y, rho), a in zip(steps, reversed(stack)):
            direction = direction + (a - rho * (y @ direction)) * s
        slope, step = float(grad @ direction), 1.0
        if slope >= 0:
            steps.clear()
            direction, slope = -grad, -float(grad @ grad)
        for _ in range(20):
            following, gradient = loss(x + step * direction)
            if following <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = step * direction, gradient - grad
        if (sy := float(s @ y)) > 1e-12:
            steps.append((s, y, 1 / sy))
        done = value - following < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, following, gradient
        if done:
            break
    return x
