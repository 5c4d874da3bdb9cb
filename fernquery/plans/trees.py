"""Queries over section trees and tables of contents. Trees are made of regions, nations and customers; lists, of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernquery.operators import chunk, toc, tree
from fernquery.plans.registry import query
from fernquery.plans.retrieval import _STRIP
from fernquery.sources.tables import table


def documents(spark, sf):
    """One structured document per region: the region, its nations, their customers. Odd nations keep theirs in ``children``."""
    c = table(spark, sf, "customer")
    leaf = F.struct(F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("node_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("text"))
    under = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", leaf.alias("s")))), lambda x: x["s"]).alias("all"))
    n = table(spark, sf, "nation").join(under, "n_nationkey", "left")
    odd = F.col("n_nationkey") % 2 == 1
    node = F.struct(F.col("n_name").alias("title"), F.lit("A nation").alias("summary"), F.when(~odd, F.col("all")).alias("nodes"), F.when(odd, F.col("all")).alias("children"))
    rows = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", node.alias("s")))), lambda x: x["s"]).alias("nodes"))
    r = table(spark, sf, "region").join(rows, "r_regionkey")
    top = F.array(F.struct(F.col("r_name").alias("title"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(" region text ").alias("text"), "nodes"))
    return r.select(F.col("r_regionkey").alias("doc_id"), F.to_json(F.struct(F.col("r_name").alias("doc_name"), top.alias("structure"))).alias("content"))


_TREE = """
k AS (SELECT n_nationkey, n_regionkey AS doc_id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
j AS (SELECT doc_id, c_custkey, c_name, c_mktsegment, i, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j FROM customer JOIN k ON c_nationkey = n_nationkey),
s AS (
  SELECT r_regionkey AS doc_id, '1' AS path, 1 AS depth, concat('r', r_regionkey) AS node_id, r_name AS title, '' AS summary, 'region text' AS text, (SELECT count(*) FROM k WHERE doc_id = r_regionkey) AS n_children, [1] AS p FROM region
  UNION ALL SELECT doc_id, concat('1.', i), 2, concat('1.', i), n_name, 'A nation', '', (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), [1, i] FROM k
  UNION ALL SELECT doc_id, concat('1.', i, '.', j), 3, CASE WHEN c_custkey % 4 <> 0 THEN concat('c', c_custkey) ELSE concat('1.', i, '.', j) END, c_name, '', CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment ELSE '' END, 0, [1, i, j] FROM j)
"""


@query("tree_flatten", f"WITH {_TREE} SELECT doc_id, path, CAST(depth AS INTEGER) AS depth, node_id, title, summary, text, CAST(n_children AS INTEGER) AS n_children FROM s")
def tree_flatten(spark, sf):
    return tree.flatten(documents(spark, sf)).select("doc_id", "path", "depth", "node_id", "title", "summary", "text", "n_children")


@query("tree_preorder_ids", f"WITH {_TREE} SELECT doc_id, path, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS VARCHAR), 4, '0') AS number FROM s")
def tree_preorder_ids(spark, sf):
    return tree.preorder_ids(tree.flatten(documents(spark, sf))).select("doc_id", "path", "number")


@query("tree_levels", f"WITH {_TREE} SELECT doc_id, path, CAST(CASE depth WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN n_children > 0 THEN 2 ELSE 1 END ELSE 1 END AS INTEGER) AS level FROM s")
def tree_levels(spark, sf):
    return tree.levels(tree.flatten(documents(spark, sf)))


@query("tree_leaves", f"WITH {_TREE} SELECT doc_id, node_id, title FROM s WHERE n_children = 0 AND text <> ''")
def tree_leaves(spark, sf):
    return tree.leaves(tree.flatten(documents(spark, sf))).select("doc_id", "node_id", "title")


@query("tree_summaries", f"WITH {_TREE} SELECT doc_id, path, CASE WHEN summary <> '' THEN summary ELSE substr(text, 1, 500) END AS shown FROM s WHERE depth = 2")
def tree_summaries(spark, sf):
    return tree.summaries(tree.flatten(documents(spark, sf)), 2).select("doc_id", "path", "shown")


@query("structured_documents", "SELECT r_regionkey AS doc_id, true AS structured FROM region UNION ALL SELECT doc_id, false FROM documents")
def structured_documents(spark, sf):
    both = documents(spark, sf).unionByName(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return both.select("doc_id", tree.is_structured(F.col("content")).alias("structured"))


@query(
    "leaf_chunks",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_STRIP.format("text")}, '\S+\s*') AS tok FROM documents),
    w AS (SELECT doc_id, tok, unnest(CASE WHEN len(tok) <= 256 THEN [0] ELSE range(0, len(tok), 224) END) AS s FROM t WHERE len(tok) > 0)
    SELECT doc_id, CAST(s // 224 AS INTEGER) AS sub_ord, CAST(CASE WHEN len(tok) <= 256 THEN 1 ELSE (len(tok) + 223) // 224 END AS INTEGER) AS sub_total, CAST(len(tok[s + 1:s + 256]) AS INTEGER) AS tokens FROM w""",
)
def leaf_chunks(spark, sf):
    leaves = table(spark, sf, "documents").select("doc_id", F.lit("s").alias("section_id"), F.lit("1").alias("path"), "text")
    return chunk.leaf_windows(leaves, 256, 32).select("doc_id", "sub_ord", "sub_total", "tokens")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey"))


def _items(spark, sf):
    """One row per order and line number; the data repeats some."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))


_ITEMS = "li AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


@query(
    "section_spans",
    f"""WITH {_ITEMS}, i AS (SELECT doc_id, ord, ord * 100 AS start, l_partkey % 3 + 1 AS level FROM li WHERE l_quantity >= 5)
    SELECT doc_id, ord, CAST(start AS INTEGER) AS start, CAST(level AS BIGINT) AS level, CAST(coalesce((SELECT min(start) FROM i b WHERE b.doc_id = a.doc_id AND b.start > a.start AND b.level <= a.level), 1000) AS INTEGER) AS stop FROM i a""",
)
def section_spans(spark, sf):
    items = _items(spark, sf).select("doc_id", "ord", F.when(F.col("l_quantity") >= 5, F.col("ord") * 100).alias("start"), (F.col("l_partkey") % 3 + 1).alias("level"))
    return tree.spans_by_level(items, 1000)


@query(
    "nearest_parent",
    f"""WITH {_ITEMS}, i AS (SELECT doc_id, ord, l_partkey % 3 + 1 AS level FROM li)
    SELECT doc_id, ord, level, (SELECT max(ord) FROM i b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM i a""",
)
def nearest_parent(spark, sf):
    return tree.parents_by_level(_items(spark, sf).select("doc_id", "ord", (F.col("l_partkey") % 3 + 1).alias("level")))


@query(
    "outline_numbers",
    f"""WITH {_ITEMS}, i AS (SELECT doc_id, ord, CAST(l_partkey % 3 + 1 AS INTEGER) AS level FROM li),
    r AS (SELECT *, sum(CAST(level < 2 AS INTEGER)) OVER w AS r2, sum(CAST(level < 3 AS INTEGER)) OVER w AS r3 FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    c AS (SELECT *, sum(CAST(level = 1 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) AS c1, sum(CAST(level = 2 AS INTEGER)) OVER (PARTITION BY doc_id, r2 ORDER BY ord) AS c2,
      sum(CAST(level = 3 AS INTEGER)) OVER (PARTITION BY doc_id, r3 ORDER BY ord) AS c3 FROM r)
    SELECT doc_id, ord, level, CASE level WHEN 1 THEN concat(c1) WHEN 2 THEN concat(c1, '.', c2) ELSE concat(c1, '.', c2, '.', c3) END AS structure FROM c""",
)
def outline_numbers(spark, sf):
    return toc.outline_numbers(_items(spark, sf).select("doc_id", "ord", (F.col("l_partkey") % 3 + 1).cast("int").alias("level")))


@query(
    "page_spans",
    f"""WITH {_ITEMS} SELECT doc_id, ord, ord * 2 AS page, greatest(ord * 2, CASE WHEN lead(ord) OVER w IS NULL THEN 20 WHEN lead(l_returnflag) OVER w = 'R' THEN lead(ord) OVER w * 2 - 1 ELSE lead(ord) OVER w * 2 END) AS end_page
    FROM li WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""",
)
def page_spans(spark, sf):
    items = _items(spark, sf).select("doc_id", "ord", (F.col("ord") * 2).alias("page"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("appear_start"))
    return tree.spans_by_page(items, F.lit(20)).select("doc_id", "ord", "page", "end_page")


_DOTTED = "CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '1.1' WHEN 3 THEN '1.1.1' WHEN 4 THEN '2' WHEN 5 THEN '3.1' WHEN 6 THEN '3.1.2' ELSE '2.1' END"


@query("tree_from_list", f"WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, {_DOTTED} AS structure FROM lineitem) SELECT doc_id, structure, (SELECT b.structure FROM i b WHERE b.doc_id = a.doc_id AND b.structure = regexp_replace(a.structure, '\\.?[0-9]+$', '')) AS parent FROM i a")
def tree_from_list(spark, sf):
    return tree.from_list(_lines(spark, sf).select("doc_id", F.expr(_DOTTED).alias("structure")).distinct()).select("doc_id", "structure", "parent")


@query("preface", "WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS structure, 'T' AS title, CAST(l_linenumber AS INTEGER) AS page FROM lineitem WHERE l_quantity > 10) SELECT * FROM i UNION ALL SELECT doc_id, '0', 'Preface', 1 FROM i GROUP BY doc_id HAVING min(page) > 1")
def preface(spark, sf):
    return tree.with_preface(_lines(spark, sf).filter("l_quantity > 10").select("doc_id", F.col("l_linenumber").cast("string").alias("structure"), F.lit("T").alias("title"), F.col("l_linenumber").alias("page")))


@query("page_texts", "SELECT conv_id AS doc_id, CAST(turn // 2 AS VARCHAR) AS structure, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY ALL")
def page_texts(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")
    items = pages.select("doc_id", F.floor((F.col("page_no") - 1) / 2).alias("n")).distinct().select("doc_id", F.col("n").cast("string").alias("structure"), (2 * F.col("n") + 1).alias("page"), (2 * F.col("n") + 2).alias("end_page"))
    return tree.page_texts(items, pages).select("doc_id", "structure", F.md5("text").alias("text_md5"))


@query("oversized_sections", "SELECT l_orderkey AS doc_id, l_linenumber AS ord FROM lineitem WHERE l_linenumber % 4 + 1 > 2 AND l_quantity >= 25")
def oversized_sections(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.col("l_linenumber").alias("ord"), F.lit(1).alias("page"), (F.col("l_linenumber") % 4 + 1).alias("end_page"), F.col("l_quantity").alias("tokens"))
    return tree.oversized(rows, 2, 25).select("doc_id", "ord")


@query(
    "page_offset_mode",
    """WITH o AS (SELECT user_id, event_id % 4 AS o, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT user_id, o AS page_offset, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM o) WHERE r = 1""",
)
def page_offset_mode(spark, sf):
    e = table(spark, sf, "events")
    pairs = e.select("user_id", F.col("event_id").alias("ord"), F.col("event_id").alias("page"), (F.col("event_id") + F.col("event_id") % 4).alias("physical"))
    return toc.page_offset(pairs, "user_id").withColumnRenamed("offset", "page_offset")


@query(
    "nearest_known_page",
    f"""WITH {_ITEMS}, i AS (SELECT doc_id, ord, CASE WHEN l_quantity >= 10 AND l_returnflag <> 'R' THEN l_partkey % 50 END AS good FROM li)
    SELECT doc_id, ord, last_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM i""",
)
def nearest_known_page(spark, sf):
    items = _items(spark, sf).select("doc_id", "ord", F.when(F.col("l_quantity") >= 10, F.col("l_partkey") % 50).alias("page"), (F.col("l_returnflag") == "R").alias("wrong"))
    return toc.nearest_known(items, "doc_id").select("doc_id", "ord", "before", "after")


_TOC = "SELECT l_orderkey AS doc_id, concat(' ', CASE WHEN l_suppkey % 13 = 0 THEN 'x' ELSE cast(l_suppkey % 12 as string) END, '.', cast(l_linenumber as string)) AS structure, CASE WHEN l_quantity < 3 THEN ' ' ELSE l_linestatus END AS title FROM {lineitem}"


@query(
    "toc_sort",
    f"""WITH i AS (SELECT DISTINCT doc_id, trim(structure) AS structure, trim(title) AS title FROM ({_TOC.format(lineitem="lineitem")}) WHERE trim(title) <> '')
    SELECT doc_id, structure, title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(structure, '.'), lambda p: coalesce(TRY_CAST(p AS INTEGER), 1000000000)), structure, title) AS INTEGER) AS place FROM i""",
)
def toc_sort(spark, sf):
    return toc.clean_items(spark.sql(_TOC, lineitem=table(spark, sf, "lineitem")), "doc_id")


@query(
    "matching_pairs",
    """SELECT a.l_orderkey AS doc_id, a.l_returnflag AS title, a.l_linenumber AS page, b.l_linenumber AS physical FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag
    WHERE a.l_quantity < 25 AND b.l_quantity >= 25 AND b.l_linenumber >= 3""",
)
def matching_pairs(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.col("l_returnflag").alias("title"), F.col("l_linenumber").alias("page"), "l_quantity")
    return toc.matching_pairs(rows.filter("l_quantity < 25").drop("l_quantity"), rows.filter("l_quantity >= 25").drop("l_quantity"), "doc_id", 3)


_SQUEEZE = r"regexp_replace(lower({}), '\s+', '', 'g')"


@query(
    "title_line_match",
    f"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    t AS (SELECT DISTINCT doc_id, substr(line, 1, 8) AS title FROM l WHERE line_no = 0),
    m AS (SELECT l.doc_id, title, line_no FROM l JOIN t USING (doc_id) WHERE {_SQUEEZE.format("title")} <> '' AND {_SQUEEZE.format("line")} <> '' AND (contains({_SQUEEZE.format("line")}, {_SQUEEZE.format("title")}) OR contains({_SQUEEZE.format("title")}, {_SQUEEZE.format("line")}))),
    r AS (SELECT doc_id, title, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS INTEGER) AS pos FROM m)
    SELECT * FROM r WHERE pos <= 6""",
)
def title_line_match(spark, sf):
    lines = chunk.lines(table(spark, sf, "documents"))
    titles = lines.filter("line_no = 0").select("doc_id", F.substring("line", 1, 8).alias("title")).distinct()
    return toc.title_candidates(titles, lines, "doc_id")


@query("title_assignment")
def title_assignment(spark, sf):
    lines = chunk.lines(table(spark, sf, "documents"))
    titles = lines.select("doc_id", F.col("line").alias("title")).distinct()
    found = toc.title_candidates(titles, lines, "doc_id").groupBy("doc_id", "title").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))
    rows = found.select("doc_id", F.get("lines", F.lit(0)).alias("ord"), "title", "lines", F.transform("lines", lambda n: n % 2 == 0).alias("verified"))
    return toc.assign_in_order(rows, "doc_id")


@query(
    "page_groups",
    r"""WITH RECURSIVE p AS (SELECT conv_id AS doc, turn + 1 AS page_no, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    t AS (SELECT doc, sum(n) AS total, CAST(ceil((sum(n) / ceil(sum(n) / 300.0) + 300) / 2) AS BIGINT) AS target FROM p GROUP BY doc),
    g AS (
      SELECT doc, i, n, 0 AS group_no, n AS size, total, target FROM p JOIN t USING (doc) WHERE i = 1
      UNION ALL SELECT p.doc, p.i, p.n, CASE WHEN total > 300 AND size + p.n > target THEN group_no + 1 ELSE group_no END, CASE WHEN total > 300 AND size + p.n > target THEN g.n + p.n ELSE size + p.n END, total, target
      FROM g JOIN p ON p.doc = g.doc AND p.i = g.i + 1),
    e AS (SELECT doc, i, group_no FROM g UNION ALL SELECT a.doc, a.i, b.group_no FROM g a JOIN g b ON a.doc = b.doc AND b.i = a.i + 1 AND b.group_no = a.group_no + 1)
    SELECT CAST(doc AS VARCHAR) AS doc, CAST(page_no AS BIGINT) AS page_no, CAST(group_no AS BIGINT) AS group_no FROM e JOIN p USING (doc, i)""",
)
def page_groups(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.size(chunk.tokens(F.col("text"))).alias("tokens"))
    return toc.page_groups(pages, 300)


@query("toc_accuracy", "SELECT l_orderkey AS doc_id, avg(CAST(l_returnflag = 'N' AS DOUBLE)) AS accuracy, count(*) AS checked FROM lineitem GROUP BY 1")
def toc_accuracy(spark, sf):
    return toc.accuracy(_lines(spark, sf).select("doc_id", F.when(F.col("l_returnflag") == "N", "yes").otherwise("no").alias("answer")), "doc_id")


@query("dot_leaders", r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, ' ', '.'), '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g')) AS text_md5 FROM documents")
def dot_leaders(spark, sf):
    """X28 over whole texts; their blanks are made dots, so that there are leaders."""
    from fernquery.functions.text import dot_leaders as leaders

    return table(spark, sf, "documents").select("doc_id", F.md5(leaders(F.translate("text", " ", "."))).alias("text_md5"))
