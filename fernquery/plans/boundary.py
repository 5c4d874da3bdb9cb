"""Queries over stores and the model boundary, with deterministic providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernquery.functions import json_salvage
from fernquery.operators import graph, models, tree
from fernquery.plans.graph import build
from fernquery.plans.registry import query
from fernquery.plans.trees import _TREE, documents
from fernquery.sources import stores
from fernquery.sources.scratch import fresh_path
from fernquery.sources.tables import table


@query("lookup", "SELECT concat('c', i) AS k, CAST(i AS INTEGER) AS ord, c_name, c_acctbal FROM range(0, 3000, 7) r(i) LEFT JOIN customer ON c_custkey = i")
def lookup(spark, sf):
    """Every seventh key, some of which the store lacks."""
    keys = spark.range(0, 3000, 7).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("k"), F.col("id").cast("int").alias("ord"))
    store = table(spark, sf, "customer").withColumn("k", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return stores.lookup(store, keys, "k", ["c_name", "c_acctbal"])


@query("graphml_round_trip", "SELECT 'node' AS kind, count(*) AS n FROM (SELECT DISTINCT n_name FROM nation) UNION ALL SELECT 'edge', count(*) FROM nation")
def graphml_round_trip(spark, sf):
    """Nations and regions written as GraphML and read again."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = n.select(F.col("n_name").alias("node_id"), F.lit('a "nation" & <more>').alias("description"))
    edges = n.select(F.col("n_name").alias("src_node_id"), F.col("r_name").alias("dst_node_id"), F.lit(1.0).alias("weight"))
    path = fresh_path(spark, "graphml")
    stores.write_graphml(nodes, edges, path)
    a, b = stores.read_graphml(spark, path)
    a = a.filter(F.col("attributes")["description"] == 'a "nation" & <more>')
    return a.select(F.lit("node").alias("kind")).unionByName(b.select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("json_salvage")
def json_salvage_query(spark, sf):
    """Replies of several broken kinds around the whole texts of documents."""
    d = table(spark, sf, "documents")
    text = F.to_json(F.struct(F.col("text").alias("answer"), F.col("doc_id").alias("n")))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("sure "), F.regexp_replace(text, r"\}$", ",}"))).otherwise(text)
    return d.select("doc_id", json_salvage.salvaged(reply).alias("salvaged"), json_salvage.loosely_read(reply).alias("loose"))


def _counting():
    return lambda prompts: [f"summary of {len(p.split())} words" for p in prompts]


@query(
    "description_summaries",
    r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\S+')) >= 500 THEN concat('summary of ', len(regexp_extract_all(text, '\S+')), ' words') ELSE md5(text) END AS described FROM documents",
)
def description_summaries(spark, sf):
    """Texts of 500 words or more are summarised, the rest stay."""
    done = models.summarise_long(table(spark, sf, "documents").select("doc_id", "text"), _counting, key="doc_id", text="text")
    return done.select("doc_id", F.when(F.startswith("text", F.lit("summary of ")), F.col("text")).otherwise(F.md5("text")).alias("described"))


@query("cached_completions", "SELECT CAST(item_id AS VARCHAR) AS source_id, concat('summary of ', len(string_split(text, ' ')) + len(string_split(text, chr(10))) - 1, ' words') AS response, item_id % 2 = 0 AS cache_hit FROM benchmark")
def cached_completions(spark, sf):
    """Even items are answered from a cache that a first call filled, odd ones by the model."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("source_id"), F.col("text").alias("prompt"))
    none = spark.createDataFrame([], "args_hash string, response string, model string")
    _, cache = models.cached_completions(b.filter("source_id % 2 = 0"), none, _counting, "m")
    return models.cached_completions(b, cache, _counting, "m")[0]


@query("embedded_nodes")
def embedded_nodes(spark, sf):
    """Vectors of the nodes that have none yet."""
    nodes = build(spark, sf)[0].select("node_id", F.concat_ws(" ", "entity_name", F.array_join("descriptions", " ")).alias("content"))
    done = table(spark, sf, "customer").select(F.concat("c_name", F.lit("::level::0")).alias("node_id"))
    vectors = models.embed_all(graph.not_vectorised(nodes, done), models.hashed_embedding(), id_col="node_id", text_col="content")
    return vectors.select("node_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)), 3).alias("total"))


@query(
    "tree_traversal",
    """SELECT r_regionkey AS doc_id, '1' AS path FROM region UNION ALL
    SELECT n_regionkey, concat('1.', i) FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i % 2 = 1""",
)
def tree_traversal(spark, sf):
    """Into every root, then into its first, third and fifth section, where it stops."""
    sections = tree.flatten(documents(spark, sf))
    choose = lambda level, depth: level.filter("ord % 2 = 0").select("doc_id", "path", F.lit(depth == 2).alias("sufficient"))
    return models.traverse(sections, choose).select("doc_id", "path")


@query("filled_summaries", rf"WITH {_TREE} SELECT doc_id, path, CASE WHEN summary <> '' THEN summary WHEN text <> '' THEN concat('summary of ', len(regexp_extract_all(text, '\S+')), ' words') ELSE '' END AS summary FROM s")
def filled_summaries(spark, sf):
    """Sections without a summary get one from the bottom up."""
    return models.fill_summaries(tree.flatten(documents(spark, sf)), _counting).select("doc_id", "path", "summary")
