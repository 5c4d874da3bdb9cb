"""Joins between chunks, sections, units and stores that report what they miss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions.text import squeezed, strip


def with_units(chunks: DataFrame, units: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks with the metadata of their unit, and the chunks without a unit, which are still to be done."""
    return chunks.join(units, key), chunks.join(units.select(*key), key, "left_anti")


def from_either(keys: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, place)`` of each key from ``first``, else from ``second``; keys that neither has are left out. Both have a key once."""
    one = first.select(key, F.col(value).alias("_one"), F.lit(True).alias("_in_one"))
    two = second.select(key, F.col(value).alias("_two"), F.lit(True).alias("_in_two"))
    met = keys.select(key).distinct().join(one, key, "left").join(two, key, "left").filter("_in_one or _in_two")
    return met.select(key, F.when(F.col("_in_one"), F.col("_one")).otherwise(F.col("_two")).alias(value), F.when(F.col("_in_one"), "first").otherwise("second").alias("place"))


def section_union(*lists: Column) -> Column:
    """The sorted distinct sections of several lists; null lists are empty."""
    return F.array_sort(F.array_distinct(reduce(F.concat, (F.coalesce(x, F.array().cast("array<string>")) for x in lists))))


def inferred_sections(nodes: DataFrame, chunks: DataFrame, *, node_col: str = "node_id", own: str = "section_ids", chunk_col: str = "chunk_id", section: str = "section_id") -> DataFrame:
    """``(node, sections)``: a node's own sections, or, where it has none, those of its chunks, sorted and distinct.

    ``nodes(node, own array, source_ids array)``; chunks without a section say nothing.
    """
    bare = nodes.filter(F.coalesce(F.size(own), F.lit(0)) <= 0)
    named = chunks.filter(strip(F.coalesce(section, F.lit(""))) != "").select(F.col(chunk_col).alias("_c"), strip(section).alias("_s"))
    told = bare.select(node_col, F.explode("source_ids").alias("_c")).distinct().join(named, "_c").groupBy(node_col).agg(F.array_sort(F.collect_set("_s")).alias("_found"))
    return nodes.join(told, node_col, "left").select(node_col, section_union(F.when(F.size(own) > 0, F.col(own)).otherwise(F.col("_found"))).alias("sections"))


def sparsity(clusters: DataFrame, layer: str = "layer", cluster: str = "cluster", before: float = 0.01) -> DataFrame:
    """Per layer, in order, the share of pairs that are in no cluster together, and its relative change against the layer before.

    ``clusters(layer, cluster)`` has a row per member. A layer of a single member has no pairs: null.
    """
    from pyspark.sql import Window

    sizes = clusters.groupBy(layer, cluster).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.groupBy(layer).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("held"), F.sum("n").alias("members"))
    rows = rows.withColumn("sparsity", F.when(F.col("members") > 1, 1 - F.col("held") / (F.col("members") * (F.col("members") - 1))))
    last = F.lag("sparsity", 1, before).over(Window.orderBy(layer))  # layers are few
    return rows.withColumn("change", F.abs(F.col("sparsity") - last) / (last + 1e-8)).select(layer, "sparsity", "change")


def next_titles(titles: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """For each title in turn, without a model, the first line past the last title's that holds it or that it holds; null where there is none.

    ``titles(by, ord, title)``, ``lines(by, line_no, line)``; white space and case aside. A
    fold over one document's titles; blank lines and titles match nothing.
    """
    t = titles.select(by, F.struct(F.col("ord"), "title", squeezed(F.col("title")).alias("t")).alias("t")).groupBy(by).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    x = lines.select(by, F.struct("line_no", squeezed(F.col("line")).alias("x")).alias("x")).filter("x.x <> ''").groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(-1).alias("cursor"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, title: Column) -> Column:
        able = F.filter("xs", lambda line: (line["line_no"] > state["cursor"]) & (title["t"] != "") & (F.contains(line["x"], title["t"]) | F.contains(title["t"], line["x"])))
        at = F.get(able, F.lit(0))["line_no"]
        return F.struct(F.coalesce(at, state["cursor"]).alias("cursor"), F.array_append(state["found"], at).alias("found"))

    both = t.join(x, by, "left").withColumn("xs", F.coalesce("xs", F.array().cast("array<struct<line_no:int,x:string>>")))
    folded = both.withColumn("found", F.aggregate("ts", start, step)["found"])
    return folded.select(by, F.posexplode("ts").alias("k", "t"), "found").select(by, F.col("t.ord").alias("ord"), F.col("t.title").alias("title"), F.get("found", F.col("k")).alias("line_no"))
