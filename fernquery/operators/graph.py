"""The property graph: built from facts by grouping, read by joins.

Extraction facts are kept as they are; nodes and edges are groupings of them, so running
an extraction again changes nothing. An edge is undirected, its ends in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions.text import PLACEHOLDER_DESCRIPTIONS, PLACEHOLDER_TYPES, entity_type, graph_level, level_id, strip, unescape_html
from fernquery.operators.ranking import top_k
from fernquery.sources.scratch import stored


def _set(c: str) -> Column:
    return F.array_sort(F.collect_set(c))


def merge_nodes(facts: DataFrame) -> DataFrame:
    """A1: one node per name and level, with sorted distinct types, descriptions and sources."""
    rows = facts.select("entity_name", "level", "source_id", "description", entity_type(F.col("entity_type")).alias("entity_type"))
    out = rows.groupBy("entity_name", "level").agg(_set("entity_type").alias("entity_types"), _set("description").alias("descriptions"), _set("source_id").alias("source_ids"), F.count(F.lit(1)).alias("frequency"))
    return out.withColumn("node_id", level_id(F.col("entity_name"), F.col("level")))


def merge_edges(facts: DataFrame) -> DataFrame:
    """A2: one edge per pair of ends and level; weights add up over the facts, so a replay of the same facts adds nothing; of facts that disagree about one place the smallest counts."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    rows = facts.select(a.alias("src"), b.alias("dst"), "level", "source_id", "ord", F.struct("weight", "description").alias("said"))
    rows = rows.groupBy("src", "dst", "level", "source_id", "ord").agg(F.min("said").alias("said")).select("src", "dst", "level", "source_id", "ord", "said.*")
    out = rows.groupBy("src", "dst", "level").agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"), _set("description").alias("descriptions"), _set("source_id").alias("source_ids"))
    return out.withColumns({"src_node_id": level_id(F.col("src"), F.col("level")), "dst_node_id": level_id(F.col("dst"), F.col("level"))})


def implicit_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: nodes that edges name and no fact describes; of unknown type, with the edges' descriptions and sources."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_name"), "level", "descriptions", "source_ids")
    missing = ends.join(nodes.select("entity_name", "level"), ["entity_name", "level"], "left_anti")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    out = missing.groupBy("entity_name", "level").agg(merged("descriptions").alias("descriptions"), merged("source_ids").alias("source_ids"))
    return out.withColumns({"entity_types": F.array(F.lit("unknown")), "node_id": level_id(F.col("entity_name"), F.col("level"))})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K3: attributes of ``new`` replace those of ``old`` where they are not null; rows of either side stay."""
    values = [c for c in old.columns if c != key]
    right = new.select(key, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_{c}") for c in values])
    return old.join(right, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K1: rows of ``new`` replace rows of ``old`` whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree)``; an edge from a node to itself counts twice."""
    return edges.select(F.explode(F.array("src_node_id", "dst_node_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Each edge with the sum of its ends' degrees."""
    d = degrees(edges)
    left, right = d.toDF("src_node_id", "a"), d.toDF("dst_node_id", "b")
    return edges.select("src_node_id", "dst_node_id").join(left, "src_node_id").join(right, "dst_node_id").select("src_node_id", "dst_node_id", (F.col("a") + F.col("b")).alias("combined_degree"))


def keyword_nodes(nodes: DataFrame, edges: DataFrame, keywords: list[str], k: int) -> DataFrame:
    """The k nodes whose names hold a keyword, by degree, then by length of description. Keywords of a query are few."""
    low = [w.strip().lower() for w in keywords if w.strip()]
    told = F.length(F.array_join("descriptions", "\n"))
    hit = nodes.filter(F.exists(F.array(*map(F.lit, low)), lambda w: F.contains(F.lower("entity_name"), w))) if low else nodes.limit(0)
    rows = hit.join(degrees(edges), "node_id", "left").select("node_id", "entity_name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), told.alias("described"))
    return rows.orderBy(F.desc("degree"), F.desc("described"), "node_id").limit(k)


def keyword_candidates(nodes: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """``keywords(keyword)`` × nodes by substring, the best ``max(3, k)`` of each by level and description length.

    The keywords, those of queries, are the small side and are broadcast.
    """
    held = nodes.join(F.broadcast(keywords), F.contains(F.lower("entity_name"), F.lower("keyword")))
    rows = held.select("keyword", "node_id", "level", F.length(F.array_join("descriptions", "\n")).alias("described"))
    return top_k(rows, max(3, k), [F.desc("level"), F.desc("described"), F.col("node_id")], ["keyword"], "pos")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources of nodes with a placeholder type or description, and of edges with an end that no node has."""
    blank = lambda c, words: F.forall(c, lambda x: F.lower(strip(x)).isin(*words))
    bad = nodes.filter(blank("entity_types", PLACEHOLDER_TYPES) | blank("descriptions", PLACEHOLDER_DESCRIPTIONS)).select(F.explode("source_ids").alias("source_id"), F.lit("node").alias("reason"))
    ends = edges.select(F.explode(F.array("src_node_id", "dst_node_id")).alias("node_id"), "source_ids")
    loose = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.explode("source_ids").alias("source_id"), F.lit("edge").alias("reason"))
    return bad.unionByName(loose).filter(F.startswith("source_id", F.lit("chunk-"))).distinct()


def incident(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges that touch the nodes of ``names(node_id)``."""
    both = edges.select(F.explode(F.array("src_node_id", "dst_node_id")).alias("node_id"), "src_node_id", "dst_node_id", "weight")
    return both.join(names, "node_id", "left_semi").drop("node_id").distinct()


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among ``names(node_id)``."""
    a, b = names.select(F.col("node_id").alias("src_node_id")), names.select(F.col("node_id").alias("dst_node_id"))
    return edges.join(a, "src_node_id", "left_semi").join(b, "dst_node_id", "left_semi")


def neighbour_chunks(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of the named nodes, with how many one-hop neighbours share each chunk.

    Neighbours' chunks are counted for each node and only then matched with its own, so
    rows grow with the neighbours' chunks and not with own chunks times neighbours.
    """
    both = edges.select(F.col("src_node_id").alias("node_id"), F.col("dst_node_id").alias("other")).unionByName(edges.select(F.col("dst_node_id").alias("node_id"), F.col("src_node_id").alias("other"))).join(names, "node_id", "left_semi").distinct()
    held = nodes.select("node_id", F.explode("source_ids").alias("chunk_id"))
    own = held.join(names, "node_id", "left_semi")
    counts = both.join(held.toDF("other", "chunk_id"), "other").groupBy("node_id", "chunk_id").agg(F.countDistinct("other").alias("n_sharing"))
    return own.join(counts, ["node_id", "chunk_id"], "left").select("node_id", "chunk_id", F.coalesce("n_sharing", F.lit(0)).alias("n_sharing"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """``(head, tail, hops, path)`` for the pairs that are joined, by at most ``most`` edges where that is given.

    All heads advance together, one join per hop; a node once reached is not entered
    again for the same head. Of equally short paths the smallest, read as a list, is
    given. Equal ends have a path of no edges. Each hop is written, which ends its
    lineage.
    """
    both = edges.select(F.col("src_node_id").alias("node"), F.col("dst_node_id").alias("following")).unionByName(edges.select(F.col("dst_node_id").alias("node"), F.col("src_node_id").alias("following"))).distinct()
    want = stored(pairs.select("head", "tail").distinct(), "pairs")
    front = want.select("head", F.col("head").alias("node"), F.array("head").alias("path")).distinct()
    seen, done, hops = front.select("head", "node"), None, 0
    while True:
        hit = want.join(front.withColumnRenamed("node", "tail"), ["head", "tail"]).select("head", "tail", F.lit(hops).alias("hops"), "path")
        hit = stored(hit, "paths")
        done = hit if done is None else done.unionByName(hit)
        want = stored(want.join(hit, ["head", "tail"], "left_anti"), "pairs")
        if hops == most or want.isEmpty():
            return done
        hops += 1
        step = front.join(want.select("head").distinct(), "head", "left_semi").join(both, "node").select("head", F.col("following").alias("node"), F.array_append("path", F.col("following")).alias("path"))
        front = stored(step.join(seen, ["head", "node"], "left_anti").groupBy("head", "node").agg(F.min("path").alias("path")), "front")
        if front.isEmpty():
            return done
        seen = stored(seen.unionByName(front.select("head", "node")), "seen")


def chained_path(edges: DataFrame, stops: list[str]) -> DataFrame:
    """``(pos, node_id)`` along shortest paths through required nodes in order; a gap without a path is bridged by the bare nodes."""
    spark = edges.sparkSession
    legs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(stops, stops[1:]))], "leg int, head string, tail string")
    found = legs.join(shortest_paths(edges, legs.select("head", "tail")), ["head", "tail"], "left")
    path = F.coalesce("path", F.array("head", "tail"))
    body = found.select("leg", F.posexplode(F.when(F.col("leg") == 0, path).otherwise(F.slice(path, 2, F.size(path)))).alias("p", "node_id"))
    return body.select("leg", "p", "node_id")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node_id, root)``: the smallest id of the component. Labels move along edges and skip ahead until none changes."""
    both = stored(edges.select(F.col("src_node_id").alias("node_id"), F.col("dst_node_id").alias("other")).unionByName(edges.select(F.col("dst_node_id").alias("node_id"), F.col("src_node_id").alias("other"))).distinct(), "both")
    labels = stored(both.select("node_id").distinct().withColumn("root", F.col("node_id")), "labels")
    while True:
        near = both.join(labels.toDF("other", "seen"), "other").groupBy("node_id").agg(F.min("seen").alias("seen"))
        low = labels.join(near, "node_id").select("node_id", F.least("root", "seen").alias("root"))
        jump = low.join(labels.toDF("via", "far"), F.col("root") == F.col("via")).select("node_id", F.least("root", "far").alias("root"))
        following = stored(jump, "labels")
        if following.join(labels, ["node_id", "root"], "left_anti").isEmpty():
            return following
        labels = following


def largest_component(edges: DataFrame) -> DataFrame:
    """The nodes of the largest component, of equally large ones that with the smallest node: ``(node_id, label)``, the label in upper case."""
    labels = connected_components(edges)
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "root").limit(1).select("root")
    return labels.join(F.broadcast(best), "root").select("node_id", unescape_html(strip(F.upper("node_id"))).alias("label"))


def stable_order(edges: DataFrame) -> DataFrame:
    """Edges with their ends in order, sorted."""
    return edges.select(F.least("src_node_id", "dst_node_id").alias("a"), F.greatest("src_node_id", "dst_node_id").alias("b")).orderBy("a", "b")


def workbench_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K7: entities as they are exported for browsing: first type in upper case, frequency, degree."""
    d = degrees(edges)
    return nodes.join(d, "node_id", "left").select(F.md5("node_id").alias("id"), F.col("entity_name").alias("title"), F.upper(F.get("entity_types", F.lit(0))).alias("type"), F.array_join("descriptions", "\n").alias("description"), F.size("source_ids").alias("frequency"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "level")


def workbench_relations(edges: DataFrame) -> DataFrame:
    d = edge_degrees(edges)
    return edges.join(d, ["src_node_id", "dst_node_id"]).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.array_join("descriptions", "\n").alias("description"), F.round("weight", 4).alias("weight"), "combined_degree", F.size("source_ids").alias("n_text_units"))


def level_entities(nodes: DataFrame) -> DataFrame:
    """Entities with the graph they belong to."""
    return nodes.select("entity_name", F.get("entity_types", F.lit(0)).alias("entity_type"), "level", graph_level(F.col("level")).alias("graph_level"), F.col("frequency").cast("double").alias("weight"), F.size("source_ids").alias("n_chunks"))


def level_relations(facts: DataFrame) -> DataFrame:
    """A5: relations by ends and level; a weight that is no number counts 1."""
    rows = facts.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"), "level", F.coalesce(F.col("weight").cast("string").try_cast("double"), F.lit(1.0)).alias("w"))
    return rows.groupBy("source", "target", "level").agg(F.round(F.sum("w"), 4).alias("weight"), F.count(F.lit(1)).alias("n")).withColumn("graph_level", graph_level(F.col("level")))


def not_vectorised(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes that no vector row stands for yet."""
    return nodes.join(vectors.select("node_id"), "node_id", "left_anti")
