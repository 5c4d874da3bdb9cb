"""Token usage: facts of model calls and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facts(calls: DataFrame, stage: str, model: str, source: str, *, prompt_col: str = "prompt", reply_col: str = "response") -> DataFrame:
    """A usage fact per model call, ``(stage, model, source, prompt_tokens, completion_tokens, total_tokens)``.

    Numbers that the provider told, in columns of those names, are taken; else words are
    counted. A null prompt or reply has none.
    """
    words = lambda c: F.size(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\S+"), 0))
    told = lambda name, counted: F.coalesce(F.col(name).cast("long"), counted.cast("long")) if name in calls.columns else counted.cast("long")
    p, c = told("prompt_tokens", words(prompt_col)), told("completion_tokens", words(reply_col))
    return calls.select(F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(source).alias("source"), p.alias("prompt_tokens"), c.alias("completion_tokens"), told("total_tokens", p + c).alias("total_tokens"))


def rollup(calls: DataFrame) -> DataFrame:
    """Sums of ``calls(stage, model, source, prompt_tokens, completion_tokens, total_tokens)`` per stage, stage and model, stage and source, and in all.

    A missing total is prompt plus completion; negative numbers count 0. ``grain`` names
    the grouping.
    """
    p, c = (F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) for n in ("prompt_tokens", "completion_tokens"))
    rows = calls.select("stage", "model", "source", p.alias("p"), c.alias("c"), F.greatest(F.coalesce("total_tokens", p + c), F.lit(0)).alias("t"))
    sets = [["stage"], ["stage", "model"], ["stage", "source"], []]
    out = rows.groupingSets([[F.col(x) for x in s] for s in sets], "stage", "model", "source").agg(F.sum("p").cast("long").alias("prompt_tokens"), F.sum("c").cast("long").alias("completion_tokens"), F.sum("t").cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("g"))
    grain = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "stage").when(F.col("g") == 1, "model").otherwise("source")
    return out.withColumn("grain", grain).drop("g")


def report(rolled: DataFrame) -> DataFrame:
    """A roll-up as ``(place, line)``: the total first, then a line per stage in order of name; without usage a line that says so."""
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("calls", "prompt_tokens", "completion_tokens", "total_tokens")])
    lines = rolled.filter("grain = 'all' and calls > 0").select(F.lit(0).alias("part"), F.lit("").alias("stage"), F.concat(F.lit("Total: "), told).alias("line"))
    lines = lines.unionByName(rolled.filter("grain = 'stage'").select(F.lit(1).alias("part"), "stage", F.concat(F.lit("["), F.coalesce("stage", F.lit("")), F.lit("] "), told).alias("line")))
    none = rolled.agg(F.coalesce(F.max("calls"), F.lit(0)).alias("n")).filter("n = 0").select(F.lit(2).alias("part"), F.lit("").alias("stage"), F.lit("No usage.").alias("line"))
    return lines.unionByName(none).select(F.row_number().over(Window.orderBy("part", "stage")).alias("place"), "line")  # stages are few
