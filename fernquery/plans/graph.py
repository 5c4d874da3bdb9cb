"""Queries over a property graph made of the star schema: facts first, nodes and edges as groupings of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernquery.operators import graph
from fernquery.plans.registry import query
from fernquery.sources.tables import table

_TABLES = ("customer", "supplier", "nation", "region", "lineitem")
_ENTITIES = """
SELECT concat('chunk-c', cast(c_custkey as string)) AS source_id, 0 AS ord, c_name AS entity_name, 'Customer' AS entity_type, concat('Customer in segment ', c_mktsegment) AS description, 0 AS level FROM {customer}
UNION ALL SELECT concat('chunk-c', cast(c_custkey as string)), 1, n_name, 'Nation', concat('Home of ', c_mktsegment), 0 FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey
UNION ALL SELECT concat('chunk-s', cast(s_suppkey as string)), 0, s_name, CASE WHEN s_suppkey % 10 = 0 THEN ' N/A' ELSE 'Supplier' END, CASE WHEN s_suppkey % 15 = 0 THEN 'None' ELSE 'A supplier' END, 0 FROM {supplier}
UNION ALL SELECT concat('struct-n', cast(n_nationkey as string)), 0, n_name, 'Nation', 'A nation', 1 FROM {nation}
UNION ALL SELECT concat('struct-r', cast(r_regionkey as string)), 0, r_name, 'Region', 'A region', 2 FROM {region}
"""
_RELATIONS = """
SELECT concat('chunk-l', cast(l_orderkey as string)) AS source_id, l_linenumber AS ord, s_name AS src, concat('Part ', cast(l_partkey as string)) AS dst, sum(l_quantity) AS weight, concat('supplies under ', max(l_returnflag)) AS description, 0 AS level
FROM {lineitem} l JOIN {supplier} s ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_linenumber, s_name, l_partkey
UNION ALL SELECT concat('chunk-c', cast(c_custkey as string)), 0, n_name, c_name, 1.0, 'is home of', 0 FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey
UNION ALL SELECT concat('chunk-s', cast(s_suppkey as string)), 0, s_name, n_name, 2.0, 'is based in', 0 FROM {supplier} s JOIN {nation} n ON s_nationkey = n_nationkey
UNION ALL SELECT concat('struct-n', cast(n_nationkey as string)), 0, n_name, r_name, 1.0, 'lies in', 0 FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey
"""


def facts(spark, sf):
    tables = {t: table(spark, sf, t) for t in _TABLES}
    use = lambda sql: spark.sql(sql, **{t: d for t, d in tables.items() if "{" + t + "}" in sql})
    return use(_ENTITIES), use(_RELATIONS)


_PLAIN = {t: t for t in _TABLES}
_GRAPH = f"""
fe AS ({_ENTITIES.format(**_PLAIN)}), fr AS ({_RELATIONS.format(**_PLAIN)}),
nodes AS (
  SELECT entity_name, level, concat(entity_name, '::level::', level) AS node_id, count(*) AS frequency,
    list_sort(list(DISTINCT CASE WHEN lower(trim(entity_type)) = 'n/a' THEN 'unknown' ELSE lower(trim(entity_type)) END)) AS types, list_sort(list(DISTINCT description)) AS descriptions, list_sort(list(DISTINCT source_id)) AS sources
  FROM fe GROUP BY entity_name, level),
edges AS (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, level, concat(least(src, dst), '::level::', level) AS src_node_id, concat(greatest(src, dst), '::level::', level) AS dst_node_id,
    sum(weight) AS weight, min(ord) AS ord, list_sort(list(DISTINCT description)) AS descriptions, list_sort(list(DISTINCT source_id)) AS sources
  FROM fr GROUP BY least(src, dst), greatest(src, dst), level),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src_node_id AS node_id FROM edges UNION ALL SELECT dst_node_id FROM edges) GROUP BY node_id)
"""


def build(spark, sf):
    e, r = facts(spark, sf)
    return graph.merge_nodes(e), graph.merge_edges(r)


@query("merge_nodes", f"WITH {_GRAPH} SELECT node_id, level, frequency, array_to_string(types, '~') AS types, array_to_string(descriptions, '~') AS descriptions, CAST(len(sources) AS INTEGER) AS n_sources FROM nodes")
def merge_nodes(spark, sf):
    return build(spark, sf)[0].select("node_id", "level", "frequency", F.array_join("entity_types", "~").alias("types"), F.array_join("descriptions", "~").alias("descriptions"), F.size("source_ids").alias("n_sources"))


@query("merge_edges", f"WITH {_GRAPH} SELECT src_node_id, dst_node_id, weight, CAST(ord AS INTEGER) AS ord, array_to_string(descriptions, '~') AS descriptions, CAST(len(sources) AS INTEGER) AS n_sources FROM edges")
def merge_edges(spark, sf):
    return build(spark, sf)[1].select("src_node_id", "dst_node_id", "weight", "ord", F.array_join("descriptions", "~").alias("descriptions"), F.size("source_ids").alias("n_sources"))


@query(
    "implicit_endpoints",
    f"""WITH {_GRAPH}, ends AS (SELECT src AS entity_name, level, descriptions, sources FROM edges UNION ALL SELECT dst, level, descriptions, sources FROM edges)
    SELECT concat(entity_name, '::level::', level) AS node_id, array_to_string(list_sort(list_distinct(flatten(list(descriptions)))), '~') AS descriptions, CAST(len(list_distinct(flatten(list(sources)))) AS INTEGER) AS n_sources
    FROM ends ANTI JOIN nodes USING (entity_name, level) GROUP BY entity_name, level""",
)
def implicit_endpoints(spark, sf):
    return graph.implicit_endpoints(*build(spark, sf)).select("node_id", F.array_join("descriptions", "~").alias("descriptions"), F.size("source_ids").alias("n_sources"))


@query("node_degree", f"WITH {_GRAPH} SELECT node_id, degree FROM deg")
def node_degree(spark, sf):
    return graph.degrees(build(spark, sf)[1])


@query("edge_degree", f"WITH {_GRAPH} SELECT src_node_id, dst_node_id, a.degree + b.degree AS combined_degree FROM edges JOIN deg a ON a.node_id = src_node_id JOIN deg b ON b.node_id = dst_node_id")
def edge_degree(spark, sf):
    return graph.edge_degrees(build(spark, sf)[1])


@query(
    "keyword_nodes",
    f"""WITH {_GRAPH} SELECT node_id, entity_name, coalesce(degree, 0) AS degree, CAST(length(array_to_string(descriptions, chr(10))) AS INTEGER) AS described
    FROM nodes LEFT JOIN deg USING (node_id) WHERE contains(lower(entity_name), 'supplier') OR contains(lower(entity_name), 'asia') ORDER BY degree DESC, described DESC, node_id LIMIT 20""",
)
def keyword_nodes(spark, sf):
    return graph.keyword_nodes(*build(spark, sf), ["Supplier", "asia"], 20)


@query(
    "keyword_candidates",
    f"""WITH {_GRAPH}, k AS (SELECT r_name AS keyword FROM region UNION ALL SELECT n_name FROM nation),
    h AS (SELECT keyword, node_id, level, CAST(length(array_to_string(descriptions, chr(10))) AS INTEGER) AS described FROM nodes, k WHERE contains(lower(entity_name), lower(keyword))),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY keyword ORDER BY level DESC, described DESC, node_id) AS INTEGER) AS pos FROM h)
    SELECT keyword, node_id, level, described, pos FROM r WHERE pos <= 5""",
)
def keyword_candidates(spark, sf):
    words = table(spark, sf, "region").select(F.col("r_name").alias("keyword")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("keyword")))
    return graph.keyword_candidates(build(spark, sf)[0], words, 5)


@query(
    "integrity_scan",
    f"""WITH {_GRAPH}, bad AS (SELECT unnest(sources) AS source_id, 'node' AS reason FROM nodes WHERE types = ['unknown'] OR len(list_filter(descriptions, lambda x: lower(trim(x)) NOT IN ('', 'none'))) = 0),
    loose AS (SELECT unnest(sources) AS source_id, 'edge' AS reason FROM edges WHERE src_node_id NOT IN (SELECT node_id FROM nodes) OR dst_node_id NOT IN (SELECT node_id FROM nodes))
    SELECT DISTINCT source_id, reason FROM (SELECT * FROM bad UNION ALL SELECT * FROM loose) WHERE starts_with(source_id, 'chunk-')""",
)
def integrity_scan(spark, sf):
    return graph.integrity(*build(spark, sf))


def _named(spark, sf):
    return table(spark, sf, "nation").select(F.concat("n_name", F.lit("::level::0")).alias("node_id"))


_NAMED = "named AS (SELECT concat(n_name, '::level::0') AS node_id FROM nation)"


@query("incident_edges", f"WITH {_GRAPH}, {_NAMED} SELECT src_node_id, dst_node_id, weight FROM edges WHERE src_node_id IN (SELECT node_id FROM named) OR dst_node_id IN (SELECT node_id FROM named)")
def incident_edges(spark, sf):
    return graph.incident(build(spark, sf)[1], _named(spark, sf))


@query("induced_edges", f"WITH {_GRAPH}, few AS (SELECT node_id FROM deg WHERE degree >= 20) SELECT src_node_id, dst_node_id, weight FROM edges WHERE src_node_id IN (SELECT node_id FROM few) AND dst_node_id IN (SELECT node_id FROM few)")
def induced_edges(spark, sf):
    edges = build(spark, sf)[1]
    return graph.induced(edges, graph.degrees(edges).filter("degree >= 20").select("node_id")).select("src_node_id", "dst_node_id", "weight")


@query(
    "neighbour_chunks",
    f"""WITH {_GRAPH}, {_NAMED}, b AS (SELECT src_node_id AS node_id, dst_node_id AS other FROM edges UNION SELECT dst_node_id, src_node_id FROM edges), h AS (SELECT node_id, unnest(sources) AS chunk_id FROM nodes),
    s AS (SELECT b.node_id, o.chunk_id, count(DISTINCT other) AS n FROM b JOIN named USING (node_id) JOIN h o ON o.node_id = b.other GROUP BY ALL)
    SELECT h.node_id, h.chunk_id, coalesce(n, 0) AS n_sharing FROM h JOIN named USING (node_id) LEFT JOIN s ON s.node_id = h.node_id AND s.chunk_id = h.chunk_id""",
)
def neighbour_chunks(spark, sf):
    return graph.neighbour_chunks(*build(spark, sf), _named(spark, sf))


@query(
    "shortest_paths",
    f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT DISTINCT src_node_id AS node, dst_node_id AS following FROM edges UNION SELECT dst_node_id, src_node_id FROM edges),
    heads AS (SELECT concat(r_name, '::level::0') AS head FROM region),
    walk AS (SELECT head, head AS node, 0 AS hops FROM heads UNION SELECT head, following, hops + 1 FROM walk JOIN b USING (node) WHERE hops < 8)
    SELECT head, node AS tail, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE node IN (SELECT head FROM heads) GROUP BY head, node""",
)
def shortest_paths(spark, sf):
    """G12 between all regions, however far; the paths themselves are checked in the tests."""
    edges = build(spark, sf)[1]
    heads = table(spark, sf, "region").select(F.concat("r_name", F.lit("::level::0")).alias("head"))
    pairs = heads.join(F.broadcast(heads.withColumnRenamed("head", "tail")))
    return graph.shortest_paths(edges, pairs).select("head", "tail", "hops")


@query("chained_path")
def chained_path(spark, sf):
    return graph.chained_path(build(spark, sf)[1], ["AFRICA::level::0", "ASIA::level::0", "EUROPE::level::0"])


@query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS a, concat('r', n_regionkey) AS b FROM nation), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    w AS (SELECT a AS node_id, a AS root FROM b UNION SELECT b.b, root FROM w JOIN b ON b.a = w.node_id) SELECT node_id, min(root) AS root FROM w GROUP BY node_id""",
)
def connected_components(spark, sf):
    edges = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src_node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst_node_id"))
    return graph.connected_components(edges)


@query(
    "workbench_entities",
    f"""WITH {_GRAPH} SELECT md5(node_id) AS id, entity_name AS title, upper(types[1]) AS type, array_to_string(descriptions, chr(10)) AS description, CAST(len(sources) AS INTEGER) AS frequency, coalesce(degree, 0) AS degree, CAST(level AS INTEGER) AS level
    FROM nodes LEFT JOIN deg USING (node_id)""",
)
def workbench_entities(spark, sf):
    return graph.workbench_entities(*build(spark, sf))


@query(
    "workbench_relations",
    f"""WITH {_GRAPH} SELECT src AS source, dst AS target, array_to_string(descriptions, chr(10)) AS description, round(weight, 4) AS weight, a.degree + b.degree AS combined_degree, CAST(len(sources) AS INTEGER) AS n_text_units
    FROM edges JOIN deg a ON a.node_id = src_node_id JOIN deg b ON b.node_id = dst_node_id""",
)
def workbench_relations(spark, sf):
    return graph.workbench_relations(build(spark, sf)[1])


@query("level_entities", f"WITH {_GRAPH} SELECT entity_name, types[1] AS entity_type, CAST(level AS INTEGER) AS level, CASE WHEN level >= 1 THEN 'structural' ELSE 'content' END AS graph_level, CAST(frequency AS DOUBLE) AS weight, CAST(len(sources) AS INTEGER) AS n_chunks FROM nodes")
def level_entities(spark, sf):
    return graph.level_entities(build(spark, sf)[0])


@query("level_relations", f"WITH {_GRAPH} SELECT least(src, dst) AS source, greatest(src, dst) AS target, CAST(level AS INTEGER) AS level, round(sum(weight), 4) AS weight, count(*) AS n, 'content' AS graph_level FROM fr GROUP BY ALL")
def level_relations(spark, sf):
    return graph.level_relations(facts(spark, sf)[1])


@query("node_upsert", f"WITH {_GRAPH} SELECT node_id, coalesce(d.degree, n.frequency) AS frequency, n.entity_name AS entity_name FROM nodes n FULL JOIN (SELECT node_id, CASE WHEN degree > 5 THEN degree END AS degree FROM deg) d USING (node_id)")
def node_upsert(spark, sf):
    nodes, edges = build(spark, sf)
    new = graph.degrees(edges).select("node_id", F.when(F.col("degree") > 5, F.col("degree")).alias("frequency"))
    return graph.upsert(nodes.select("node_id", "frequency", "entity_name"), new, "node_id")


@query("not_vectorised", f"WITH {_GRAPH} SELECT node_id, entity_name FROM nodes WHERE node_id NOT IN (SELECT concat(c_name, '::level::0') FROM customer)")
def not_vectorised(spark, sf):
    done = table(spark, sf, "customer").select(F.concat("c_name", F.lit("::level::0")).alias("node_id"))
    return graph.not_vectorised(build(spark, sf)[0], done).select("node_id", "entity_name")
