"""Queries over flows around a model, whose providers answer by rule, so that SQL can say what must come out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fernquery.operators import chunk, evidence, extract, flows, graph, tree, usage
from fernquery.plans.evidence import _CHUNK_HITS, _selected
from fernquery.plans.graph import _GRAPH, build, facts
from fernquery.plans.registry import query
from fernquery.plans.retrieval import _CHUNKS
from fernquery.plans.trees import _TREE, documents
from fernquery.sources import stores
from fernquery.sources.scratch import fresh_path
from fernquery.sources.tables import table


def _sizes():
    """Answers a chunk with records of its number of words; wants to go on after an even number of them."""

    def one(prompt: str) -> str:
        n = len(prompt.split())
        if prompt.endswith("\nENOUGH?"):
            return "yes" if len(prompt.split("\n(", 1)[0].split()) % 2 == 0 else "no"
        if prompt.endswith("\nMORE"):
            return '##("entity"<|>even<|>parity<|>an even chunk)'
        return f'("entity"<|>n{n // 100}<|>Size<|>{n} words)##("relationship"<|>n{n // 100}<|>t{n % 10}<|>ends with<|>2)'

    return lambda prompts: [one(p) for p in prompts]


@query(
    "indexed_documents",
    rf"""WITH {_CHUNKS.format(size=1200, step=1100)}, c AS (SELECT md5(content) AS k, any_value(len(regexp_extract_all(content, '\S+'))) AS n FROM chunks GROUP BY 1),
    e AS (SELECT concat('N', n // 100) AS name, concat(n, ' words') AS description, 'size' AS type, k FROM c UNION ALL SELECT 'EVEN', 'an even chunk', 'parity', k FROM c WHERE n % 2 = 0),
    r AS (SELECT least(concat('N', n // 100), concat('T', n % 10)) AS a, greatest(concat('N', n // 100), concat('T', n % 10)) AS b, k FROM c),
    ends AS (SELECT a AS name, k, 1 AS x, a, b FROM r UNION ALL SELECT b, k, 1, a, b FROM r),
    d AS (SELECT name, count(DISTINCT concat(a, '~', b)) AS degree FROM ends GROUP BY name),
    nodes AS (SELECT name, any_value(type) AS type, count(DISTINCT description) AS n_told, count(DISTINCT k) AS n_sources FROM e GROUP BY name
      UNION ALL SELECT name, 'unknown', 1, count(DISTINCT k) FROM ends WHERE name NOT IN (SELECT name FROM e) GROUP BY name)
    SELECT concat(name, '::level::0') AS node_id, type, CAST(n_told AS INTEGER) AS n_told, CAST(n_sources AS INTEGER) AS n_sources, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (name)""",
)
def indexed_documents(spark, sf):
    """M7: documents to chunks, extraction with a continuation, graph, degrees."""
    nodes, edges = flows.index_chunks(chunk.token_windows(table(spark, sf, "documents")), _sizes)
    rows = nodes.join(graph.degrees(edges), "node_id", "left")
    return rows.select("node_id", F.array_join("entity_types", "~").alias("type"), F.size("descriptions").alias("n_told"), F.size("source_ids").alias("n_sources"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query(
    "repaired_graph",
    f"""WITH {_GRAPH}, bad AS (SELECT DISTINCT source_id FROM fe JOIN (SELECT node_id, sources FROM nodes WHERE list_has_all(['unknown', ''], types) OR list_has_all(['None'], descriptions)) n ON list_contains(sources, source_id) WHERE source_id LIKE 'chunk-s%')
    SELECT source_id, ord, entity_name, CASE WHEN b THEN 'Supplier' ELSE entity_type END AS entity_type, CASE WHEN b THEN 'Told again' ELSE description END AS description FROM (SELECT fe.*, source_id IN (SELECT source_id FROM bad) AS b FROM fe)""",
)
def repaired_graph(spark, sf):
    """Sources of nodes without a type or description are extracted again."""
    entities, relations = facts(spark, sf)
    nodes, edges = build(spark, sf)
    nodes = nodes.unionByName(graph.implicit_endpoints(nodes, edges), allowMissingColumns=True)
    found = graph.integrity(nodes, edges).filter("reason = 'node' and startswith(source_id, 'chunk-s')")
    again = entities.withColumns({"entity_type": F.lit("Supplier"), "description": F.lit("Told again")})
    return flows.repaired(entities, again, found).select("source_id", "ord", "entity_name", "entity_type", "description")


def _pieces():
    """Answers with the first and last word of a text; of every third length in something that is no JSON."""

    def one(p: str) -> str:
        w = p.split()
        if not w or len(w) % 3 == 0:
            return "sorry"
        return "Here: " + json.dumps({"entities": [w[0], w[-1], w[0], " "], "relations": [f"{w[0]} -> {w[-1]}; none"], "questions": f"what about {len(w)} words"})

    return lambda prompts: [one(p) for p in prompts]


@query(
    "query_decomposition",
    r"""SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN ok THEN array_to_string(CASE WHEN a = z THEN [a] ELSE [a, z] END, '~') ELSE '' END AS entities, CASE WHEN ok THEN concat(a, '>', z) ELSE '' END AS relations, CASE WHEN ok THEN concat('what about ', len(w), ' words') ELSE '' END AS questions
    FROM (SELECT item_id, w, w[1] AS a, w[len(w)] AS z, len(w) > 0 AND len(w) % 3 <> 0 AS ok FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark))""",
)
def query_decomposition(spark, sf):
    """M11 over the benchmark's texts."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    ends = F.array_join(F.transform("relations", lambda r: F.concat_ws(">", r["head"], r["tail"])), "~")
    return flows.decompose(asked, _pieces).select("query_id", F.array_join("entities", "~").alias("entities"), ends.alias("relations"), F.array_join("questions", "~").alias("questions"))


def _words():
    return lambda prompts: [f"{len(p.split())} words" if len(p.split()) % 5 else " None " for p in prompts]


@query(
    "leaf_answers",
    r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations WHERE regexp_matches(text, '\S')),
    k AS (SELECT conv_id, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, n) AS running FROM t), c AS (SELECT conv_id, sum(n) + 2 AS n FROM k WHERE running <= 512 GROUP BY conv_id)
    SELECT conv_id, q AS question, CASE WHEN n % 5 <> 0 THEN concat(n, ' words') END AS answer FROM c, (VALUES ('What said?'), ('Who spoke?')) v(q)""",
)
def leaf_answers(spark, sf):
    """Two questions of every conversation, over its turns as far as the tokens go."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    asked = turns.select("conv_id", F.explode(F.array(F.lit("What said?"), F.lit("Who spoke?"))).alias("question"))
    return flows.answer_leaves(turns, asked, _words, by="conv_id", most=100)


@query(
    "path_evidence",
    """WITH n AS (SELECT n_nationkey, n_regionkey, n_name, r_name, lead(n_name) OVER (ORDER BY n_nationkey) AS following, lead(n_regionkey) OVER (ORDER BY n_nationkey) AS fr FROM nation JOIN region ON r_regionkey = n_regionkey),
    p AS (SELECT n_name AS head, following AS tail, r_name, n_name AS step, 0 AS i FROM n WHERE fr = n_regionkey UNION ALL SELECT n_name, following, r_name, following, 1 FROM n WHERE fr = n_regionkey)
    SELECT least(step, r_name) AS src_node_id, greatest(step, r_name) AS dst_node_id, count(*) AS n_paths FROM p GROUP BY 1, 2""",
)
def path_evidence(spark, sf):
    """The steps of paths between nations that follow each other, through their region; nations of different regions are not joined."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = n.select(F.col("n_name").alias("src_node_id"), F.col("r_name").alias("dst_node_id"))
    after = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("tail"))
    pairs = n.select("n_nationkey", F.col("n_name").alias("head")).join(after, "n_nationkey").select("head", "tail")
    steps = flows.path_relations(graph.shortest_paths(edges, pairs), ["head", "tail"])
    rows = steps.withColumns({"tag": F.lit("path"), "rank": F.lit(1), "description": F.lit("step"), "source_id": F.concat_ws(">", "head", "tail")})
    counts = rows.groupBy("src_node_id", "dst_node_id").agg(F.countDistinct("source_id").alias("n_paths"))
    return evidence.merge_evidence(rows, ["src_node_id", "dst_node_id"]).join(counts, ["src_node_id", "dst_node_id"]).select("src_node_id", "dst_node_id", "n_paths")


def _odd():
    return lambda prompts: ["yes" if len(p.split("\n", 1)[0]) and p.count("\n") % 2 else " No" for p in prompts]


@query(
    "title_checks",
    r"""WITH t AS (SELECT conv_id AS doc_id, turn AS ord, substr(text, 1, 12) AS title, turn + CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS page FROM conversations WHERE text IS NOT NULL),
    m AS (SELECT t.*, c.text, regexp_replace(lower(title), '\s+', '', 'g') AS a, regexp_replace(lower(c.text), '\s+', '', 'g') AS x FROM t LEFT JOIN conversations c ON c.conv_id = doc_id AND c.turn = page)
    SELECT doc_id, ord, title, page, CASE WHEN text IS NULL THEN 'no' WHEN a <> '' AND contains(x, a) THEN 'yes' WHEN (length(title) - length(replace(title, chr(10), '')) + length(text) - length(replace(text, chr(10), ''))) % 2 = 1 THEN 'yes' ELSE 'no' END AS answer FROM m""",
)
def title_checks(spark, sf):
    """Beginnings of turns looked for in their own turn or in the next."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    page = F.col("page_no") + F.when(F.col("page_no") % 3 == 0, 0).otherwise(1)
    items = c.filter("text is not null").select("doc_id", F.col("page_no").alias("ord"), F.substring("text", 1, 12).alias("title"), page.alias("page"))
    return flows.title_checks(items, c, _odd, by="doc_id")


@query(
    "toc_attempts",
    """WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS step, l_discount * 10 AS accuracy FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)),
    s AS (SELECT doc_id, coalesce(min(CASE WHEN accuracy > 0.6 THEN step END), max(step)) AS step FROM a GROUP BY 1)
    SELECT doc_id, step, CASE WHEN accuracy >= 1 THEN 'accept' WHEN accuracy > 0.6 THEN 'mend' ELSE 'last' END AS verdict FROM s JOIN a USING (doc_id, step)""",
)
def toc_attempts(spark, sf):
    """Order lines as attempts, discounts as their accuracy."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("step")).agg((F.max("l_discount") * 10).alias("accuracy"))
    return flows.best_attempts(a, "doc_id").select("doc_id", "step", "verdict")


def _headings():
    """The number of lines, complete from sixteen on."""

    def one(p: str) -> str:
        n = p.count("\n") + 1
        return json.dumps({"items": ["more"] if p.startswith("CONTINUE\n") else [str(n)], "state": "complete" if n >= 16 else "open"})

    return lambda prompts: [one(p) for p in prompts]


@query(
    "text_contents",
    """WITH n AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN n >= 16 THEN '16' ELSE concat(n, '~more') END AS items, CAST(CASE WHEN n > 8 THEN 3 WHEN n > 4 THEN 2 ELSE 1 END + CASE WHEN n >= 16 THEN 0 ELSE 1 END AS INTEGER) AS asked FROM n""",
)
def text_contents(spark, sf):
    """Windows of 4, 8, 16 lines over the documents."""
    return flows.contents_of_text(table(spark, sf, "documents"), _headings, id_col="doc_id", first=4).select("doc_id", F.array_join("items", "~").alias("items"), "asked")


def _count():
    return lambda prompts: [f"{len(p.split())} words" for p in prompts]


@query(
    "text_summaries",
    r"""WITH n AS (SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN n > 300 THEN concat(2 * ((n + 199) // 200), ' words') ELSE md5(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) END AS summary FROM n""",
)
def text_summaries(spark, sf):
    """Texts of up to 300 words stay, others are cut at every 200."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.size(chunk.tokens(x)), F.lit(200)), lambda s: F.array_join(F.slice(chunk.tokens(x), s, 200), ""))
    above, _ = flows.summaries_of_texts(table(spark, sf, "documents").select("doc_id", "text"), _count, cut, key="doc_id", most=300)
    return above.select("doc_id", F.when(F.col("summary").rlike("^[0-9]+ words$"), F.col("summary")).otherwise(F.md5("summary")).alias("summary"))


@query(
    "split_sections",
    """WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, '1' AS path, CAST(1 AS BIGINT) AS "first", count(*) AS "last" FROM orders GROUP BY 1
      UNION ALL SELECT doc_id, concat(path, '.', i), CASE i WHEN 1 THEN "first" ELSE ("first" + "last") // 2 + 1 END, CASE i WHEN 1 THEN ("first" + "last") // 2 ELSE "last" END FROM s, (VALUES (1), (2)) v(i) WHERE "last" - "first" + 1 > 3)
    SELECT doc_id, path, "first", "last" FROM s""",
)
def split_sections(spark, sf):
    """A customer's orders as pages, halved until three or fewer are left."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("last")).select("doc_id", F.lit("1").alias("path"), F.lit(1).cast("long").alias("first"), "last", (F.col("last") * 10).alias("tokens"))

    def halves(large):
        mid = F.floor((F.col("first") + F.col("last")) / 2)
        both = F.array(F.struct(F.lit(".1").alias("p"), F.col("first").alias("a"), mid.alias("z")), F.struct(F.lit(".2").alias("p"), (mid + 1).alias("a"), F.col("last").alias("z")))
        return large.select("doc_id", "path", F.explode(both).alias("h")).select("doc_id", F.concat("path", "h.p").alias("path"), F.col("h.a").alias("first"), F.col("h.z").alias("last"), ((F.col("h.z") - F.col("h.a") + 1) * 10).alias("tokens"))

    return flows.split_large(s, halves, pages=3, tokens=10).select("doc_id", "path", "first", "last")


@query(
    "dual_query",
    rf"""WITH {_CHUNK_HITS}, n AS (SELECT n_nationkey, n_regionkey, n_name, r_name, lead(n_name) OVER (ORDER BY n_nationkey) AS following, lead(n_regionkey) OVER (ORDER BY n_nationkey) AS fr FROM nation JOIN region ON r_regionkey = n_regionkey),
    p AS (SELECT DISTINCT n_regionkey AS query_id, concat(least(step, r_name), ' -- ', greatest(step, r_name)) AS text FROM (SELECT n_regionkey, n_name AS step, r_name FROM n WHERE fr = n_regionkey UNION ALL SELECT n_regionkey, following, r_name FROM n WHERE fr = n_regionkey)),
    rows AS (
      SELECT 0 AS part, 'entities' AS name, query_id, CAST(pos AS BIGINT) AS pos, concat(node_id, ' ', array_to_string(descriptions, '; ')) AS text, 60 AS budget FROM sel
      UNION ALL SELECT 1, 'paths', query_id, 0, text, 1000 FROM p
      UNION ALL SELECT 2, 'chunks', query_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, first, source_id), c_name, 40 FROM h JOIN customer ON concat('chunk-c', CAST(c_custkey AS VARCHAR)) = source_id
      UNION ALL SELECT 3, 'sections', n_regionkey, n_nationkey, n_name, 1000 FROM nation WHERE n_nationkey % 4 <> 0),
    t AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS tk, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY part, query_id ORDER BY pos, text ROWS UNBOUNDED PRECEDING) AS running FROM rows),
    s AS (SELECT query_id, part, concat('# ', name, chr(10), string_agg(text, chr(10) ORDER BY pos, text)) AS sheet, sum(tk) AS tk FROM t WHERE running <= budget GROUP BY query_id, part, name),
    c AS (SELECT query_id, string_agg(sheet, chr(10) || chr(10) ORDER BY part) AS context, CAST(sum(tk) AS BIGINT) AS tokens FROM s GROUP BY query_id)
    SELECT query_id, tokens, md5(context) AS context_md5, concat(len(regexp_extract_all(context, '\S+')), ' words') AS answer FROM c""",
)
def dual_query(spark, sf):
    """Q2: per region, its nations' nodes, the paths between those that follow each other, chunks as often as they are named, and sections, each within its budget, and the answer."""
    sel = _selected(spark, sf)
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = n.select(F.col("n_name").alias("src_node_id"), F.col("r_name").alias("dst_node_id"))
    heads = n.select("n_nationkey", F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("head"))
    pairs = heads.join(n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("tail")), "n_nationkey")
    steps = flows.path_relations(graph.shortest_paths(edges, pairs).join(pairs, ["head", "tail"]), ["query_id"])
    chunks = table(spark, sf, "customer").select(F.concat(F.lit("chunk-c"), F.col("c_custkey").cast("string")).alias("source_id"), F.col("c_name").alias("text"))
    hits = evidence.count_sources(sel, "source_ids", ["query_id"])
    hits = hits.join(chunks, "source_id").withColumn("pos", F.col("place"))
    parts = {
        "entities": (sel.withColumn("text", F.concat("node_id", F.lit(" "), F.array_join("descriptions", "; "))), 60),
        "paths": (steps.select("query_id", F.lit(0).alias("pos"), F.concat_ws(" -- ", "src_node_id", "dst_node_id").alias("text")).distinct(), 1000),
        "chunks": (hits, 40),
        "sections": (n.filter("n_nationkey % 4 <> 0").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("text")), 1000),
    }
    contexts = flows.laid_out(parts, "query_id").withColumn("k", F.col("query_id").cast("string"))
    said = extract.complete_all(contexts, _count, key_col="k", prompt_col="context").select("k", F.col("response").alias("answer"))
    return contexts.join(said, "k").select("query_id", "tokens", F.md5("context").alias("context_md5"), "answer")


@query("tree_nested", f"WITH {_TREE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, path, CAST(depth AS INTEGER) AS depth, node_id, title, summary, text FROM s")
def tree_nested(spark, sf):
    """Trees flattened, put together as JSON, and flattened again."""
    again = tree.flatten(tree.nested(tree.flatten(documents(spark, sf))))
    return again.select("doc_id", "path", "depth", "node_id", "title", "summary", "text")


@query(
    "usage_report",
    """WITH c AS (SELECT o_orderpriority AS stage, count(*) AS n, sum(o_custkey % 3 + 10) AS p, sum(o_custkey % 7) AS q FROM orders GROUP BY 1),
    l AS (SELECT 1 AS part, stage, concat('[', stage, '] calls=', n, ', prompt_tokens=', p, ', completion_tokens=', q, ', total_tokens=', p + q) AS line FROM c
      UNION ALL SELECT 0, '', concat('Total: calls=', sum(n), ', prompt_tokens=', sum(p), ', completion_tokens=', sum(q), ', total_tokens=', sum(p + q)) FROM c)
    SELECT CAST(row_number() OVER (ORDER BY part, stage) AS INTEGER) AS place, line FROM l""",
)
def usage_report(spark, sf):
    """Orders as model calls."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), F.lit("m").alias("model"), F.lit("api").alias("source"), (F.col("o_custkey") % 3 + 10).alias("prompt_tokens"), (F.col("o_custkey") % 7).alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    return usage.report(usage.rollup(o))


@query(
    "page_span",
    """SELECT conv_id AS doc, md5(coalesce(string_agg(concat('<start_index_', turn, '>', chr(10), coalesce(text, ''), chr(10), '<end_index_', turn, '>', chr(10)), '' ORDER BY turn) FILTER (turn BETWEEN 1 AND 3), '')) AS text_md5, count(*) AS n_pages FROM conversations GROUP BY 1""",
)
def page_span(spark, sf):
    """Turns 1 to 3 of every conversation as tagged pages."""
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    return stores.page_span_text(pages, 1, 3, tagged=True).select("doc", F.md5("text").alias("text_md5"), "n_pages")


@query(
    "level_exports",
    f"""WITH {_GRAPH} SELECT concat(CASE WHEN level >= 1 THEN 'structural' ELSE 'content' END, '_graph_', what) AS name, count(*) AS n, count(DISTINCT id) AS n_ids FROM
    (SELECT level, 'entities' AS what, node_id AS id FROM nodes UNION ALL SELECT level, 'relations', concat(src_node_id, '~', dst_node_id) FROM edges) GROUP BY 1""",
)
def level_exports(spark, sf):
    """K8: both levels' entities and relations written as JSON and read again."""
    nodes, edges = build(spark, sf)
    out = None
    for name, path in stores.export_levels(nodes, edges, fresh_path(spark, "levels")).items():
        id_ = F.col("node_id") if name.endswith("entities") else F.concat_ws("~", "src_node_id", "dst_node_id")
        rows = spark.read.schema("node_id string, src_node_id string, dst_node_id string").json(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_).alias("n_ids")).select(F.lit(name).alias("name"), "n", "n_ids")
        out = rows if out is None else out.unionByName(rows)
    return out.filter("n > 0")
