"""Budgets, top-k, and keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(rows: DataFrame, tokens: str, budget: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The leading rows of each group whose running tokens stay within ``budget``.

    The first row that overflows cuts all later ones; a budget of 0 or less keeps
    nothing. Adds ``running``. Groups are the lists of single queries, so they are small.
    """
    if budget <= 0:
        return rows.withColumn("running", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(w).cast("long")).filter(F.col("running") <= budget)


def top_k(rows: DataFrame, k: int, order: list, by: list[str], name: str = "rank") -> DataFrame:
    """T4: the first ``k`` of each group, numbered from 1. Spark limits each task's groups before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def keep_first(rows: DataFrame, key: list, order: list) -> DataFrame:
    """Of rows with equal keys, the first."""
    return top_k(rows, 1, order, key, "_n").drop("_n")


def hit_key(kind: Column, *parts: Column) -> list[Column]:
    """The parts that identify a retrieval hit; a missing kind is an entity."""
    return [F.coalesce(F.lower(F.trim(kind)), F.lit("entity")), *[F.coalesce(p, F.lit("")) for p in parts]]


def sample_rows(rows: DataFrame, n: int | None, seed: int) -> DataFrame:
    """``n`` rows in random order; all where ``n`` is not set."""
    return rows if n is None else rows.orderBy(F.rand(seed)).limit(n)
