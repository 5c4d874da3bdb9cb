"""The model boundary: completion and embedding through one interface, with a cache of replies.

A provider is a function without arguments that opens a client and returns it: for
completion ``list[prompt] -> list[reply]``, for embedding ``list[text] -> list[vector]``.
One client is opened per task. Everything around the calls is joins and filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernquery.operators.extract import complete_all
from fernquery.operators.ranking import keep_first
from fernquery.sources.scratch import stored

Complete = Callable[[], Callable[[list[str]], list[str]]]
Embed = Callable[[], Callable[[list[str]], list[list[float]]]]


@dataclass(frozen=True)
class QuerySettings:
    """H2: what a query may set; None means not set."""

    mode: str | None = None
    top_k: int | None = None
    entity_k: int | None = None
    relation_k: int | None = None
    keyword_k: int | None = None
    text_tokens: int | None = None
    graph_tokens: int | None = None
    summary_tokens: int | None = None
    tree_traversal: bool | None = None
    only_context: bool | None = None


# What applies where neither the query nor the engine sets anything.
DEFAULTS = {"mode": "dual", "top_k": 20, "entity_k": 10, "relation_k": 10, "keyword_k": 10, "text_tokens": 20000, "graph_tokens": 20000, "summary_tokens": 20000, "tree_traversal": False, "only_context": False}


def resolved(name: str, query: QuerySettings, engine: dict | None = None):
    """The query's value if it is valid, else the engine's, else the default. Numbers must be positive; truth values may be written as text."""

    def valid(x):
        if isinstance(DEFAULTS[name], bool):
            if isinstance(x, str):
                return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}.get(x.strip().lower())
            return x if isinstance(x, bool) else None
        if isinstance(DEFAULTS[name], int):
            try:
                return int(x) if x is not None and not isinstance(x, bool) and int(x) > 0 else None
            except (TypeError, ValueError):
                return None
        return x

    for x in (getattr(query, name), (engine or {}).get(name)):
        if (v := valid(x)) is not None:
            return v
    return DEFAULTS[name]


def recorded(replies: dict[str, str], missing: str = "") -> Complete:
    """A provider that answers from a bounded table of replies by prompt; for tests."""
    return lambda: lambda prompts: [replies.get(p, missing) for p in prompts]


def hashed_embedding(width: int = 64) -> Embed:
    """A provider whose vectors depend on the words of a text alone; for tests and demonstrations."""

    def one(text: str) -> list[float]:
        out = np.zeros(width)
        for word in text.lower().split():
            h = hashlib.md5(word.encode()).digest()
            out[h[0] % width] += 1 if h[1] % 2 else -1
        return out.tolist()

    return lambda: lambda texts: [one(t) for t in texts]


def cached_completions(prompts: DataFrame, cache: DataFrame, make: Complete, model: str, *, key: str = "source_id", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Replies to ``prompts(key, prompt)`` from the cache ``(args_hash, response, model)`` where it has them, else from the model, once per distinct prompt.

    Returns the replies with ``cache_hit``, and the cache's new rows.
    """
    asked = prompts.select(F.col(key).cast("string").alias(key), prompt, F.md5(F.to_json(F.struct(F.lit(model).alias("model"), F.col(prompt).alias("prompt")))).alias("args_hash"))
    new = keep_first(asked.join(cache.select("args_hash"), "args_hash", "left_anti"), ["args_hash"], [key])
    replies = stored(complete_all(new.select(F.col("args_hash").alias(key), prompt), make, key_col=key, prompt_col=prompt).select(F.col(key).alias("args_hash"), "response", F.lit(model).alias("model")), "replies")
    both = cache.select("args_hash", "response", F.lit(True).alias("cache_hit")).unionByName(replies.select("args_hash", "response", F.lit(False).alias("cache_hit")))
    return asked.join(both, "args_hash").select(key, "response", "cache_hit"), replies


def embed_all(rows: DataFrame, make: Embed, *, id_col: str, text_col: str, batch: int = 32) -> DataFrame:
    """``(id, embedding)``, texts embedded in batches."""

    def run(batches):
        embed = make()
        for b in batches:
            ids, texts = b[0], b[1].to_pylist()
            vectors = [v for at in range(0, len(texts), batch) for v in embed([t or "" for t in texts[at : at + batch]])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def summarise_long(rows: DataFrame, make: Complete, *, key: str, text: str, tokens: int = 500) -> DataFrame:
    """Texts of ``tokens`` words or more are replaced by the model's summary; shorter ones stay."""
    counted = rows.withColumn("_n", F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0)))
    long = complete_all(counted.filter(F.col("_n") >= tokens).select(key, text), make, key_col=key, prompt_col=text).select(F.col(key).alias("_key"), F.col("response").alias("_summary"))
    return counted.join(long, F.col(key).cast("string") == F.col("_key"), "left").withColumn(text, F.coalesce("_summary", text)).drop("_n", "_key", "_summary")


def fill_summaries(sections: DataFrame, make: Complete) -> DataFrame:
    """Sections without a summary get one, from the bottom up, of their text or their children's summaries. A pass per level."""
    deepest = sections.agg(F.max("depth")).first()[0] or 0
    done = None
    for depth in range(deepest, 0, -1):
        own = sections.filter(F.col("depth") == depth)
        if done is None:
            below = own.select("doc_id", F.col("path").alias("_p"), F.lit("").alias("told")).limit(0)
        else:
            told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"]), "\n")
            below = done.filter(F.col("depth") == depth + 1).groupBy("doc_id", F.col("parent_path").alias("_p")).agg(told.alias("told"))
        met = own.join(below, (own["doc_id"] == below["doc_id"]) & (own["path"] == below["_p"]), "left").select(own["*"], F.coalesce("told", F.lit("")).alias("told"))
        ask = met.filter("summary = '' and (text <> '' or told <> '')").select(F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("k"), F.when(F.col("text") != "", F.col("text")).otherwise(F.col("told")).alias("prompt"))
        said = complete_all(ask, make, key_col="k").select(F.col("k"), F.col("response").alias("_s"))
        level = met.join(said, F.concat_ws("/", F.col("doc_id").cast("string"), "path") == F.col("k"), "left").withColumn("summary", F.coalesce("_s", "summary")).select(*sections.columns)
        level = stored(level, "summaries")
        done = level if done is None else done.unionByName(level)
    return done if done is not None else sections


def traverse(sections: DataFrame, choose: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """From the roots down, level by level, into the sections that ``choose(level, depth)`` selects.

    ``choose`` gets the level's sections and returns ``(doc_id, path, sufficient)`` of those to
    go into; a document that is sufficient stops. One pass per level.
    """
    front = sections.filter("depth = 1")
    out = None
    for depth in count(1):
        picked = stored(front.join(choose(front, depth), ["doc_id", "path"]), "picked")
        out = picked if out is None else out.unionByName(picked)
        on = picked.groupBy("doc_id").agg(F.bool_or("sufficient").alias("stop")).filter("not stop").select("doc_id")
        following = sections.join(picked.select("doc_id", F.col("path").alias("parent_path")), ["doc_id", "parent_path"], "left_semi").join(on, "doc_id", "left_semi")
        front = stored(following.select(*sections.columns), "front")
        if front.isEmpty():
            break
    return out
