"""Queries over documents: ids, chunks, term statistics, hybrid retrieval, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernquery.functions.text import prefixed_md5, search_tokens, strip
from fernquery.operators import chunk, index, ranking
from fernquery.plans.registry import query
from fernquery.sources.tables import table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""
t AS (SELECT doc_id, regexp_extract_all({_STRIP.format("text")}, '\S+\s*') AS tok FROM documents),
w AS (SELECT doc_id, s // {{step}} AS ord, tok[s + 1:s + {{size}}] AS part FROM (SELECT doc_id, tok, unnest(range(0, len(tok), {{step}})) AS s FROM t)),
chunks AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(len(part) AS INTEGER) AS tokens, {_STRIP.format("array_to_string(part, '')")} AS content FROM w)
"""


@query("doc_ids_md5", f"SELECT doc_id, concat('doc-', md5({_STRIP.format('text')})) AS doc_key FROM documents")
def doc_ids_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", prefixed_md5(strip("text"), "doc-").alias("doc_key"))


@query("token_chunks", f"WITH {_CHUNKS.format(size=256, step=224)} SELECT doc_id, ord, tokens, concat('chunk-', md5(content)) AS chunk_id FROM chunks")
def token_chunks(spark, sf):
    return chunk.token_windows(table(spark, sf, "documents"), 256, 32).select("doc_id", "ord", "tokens", "chunk_id")


@query(
    "chunk_ids_dedupe",
    f"""WITH {_CHUNKS.format(size=1200, step=1100)}, n AS (
      SELECT concat('chunk-', md5(content)) AS chunk_id, doc_id, ord, tokens, row_number() OVER (PARTITION BY md5(content) ORDER BY doc_id DESC, ord DESC) AS rn FROM chunks)
    SELECT chunk_id, doc_id, ord, tokens FROM n WHERE rn = 1""",
)
def chunk_ids_dedupe(spark, sf):
    return chunk.last_of_equal(chunk.token_windows(table(spark, sf, "documents")))


@query(
    "char_chunks",
    "SELECT doc_id, CAST(s // 500 AS INTEGER) AS ord, md5(substr(text, s + 1, 500)) AS piece_md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents)",
)
def char_chunks(spark, sf):
    return chunk.char_pieces(table(spark, sf, "documents"), 500).select("doc_id", "ord", F.md5("piece").alias("piece_md5"))


@query(
    "line_offsets",
    """WITH l AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
    SELECT doc_id, line_no, md5(line) AS line_md5, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_offset FROM l""",
)
def line_offsets(spark, sf):
    return chunk.lines(table(spark, sf, "documents")).select("doc_id", "line_no", F.md5("line").alias("line_md5"), F.col("offset").alias("line_offset"))


@query(
    "line_context",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, md5(array_to_string(list_concat(list_concat(a[greatest(i - 2, 1):i - 1], ['>> ' || a[i]]), a[i + 1:i + 2]), chr(10))) AS context_md5
    FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))""",
)
def line_context(spark, sf):
    return chunk.line_context(table(spark, sf, "documents")).select("doc_id", "line_no", F.md5("context").alias("context_md5"))


@query("separator_chunks")
def separator_chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(chunk.separator_chunks(F.col("text"), 200, 20)).alias("ord", "c")).select("doc_id", "ord", "c.tokens", F.md5("c.piece").alias("piece_md5"))


@query("paragraph_pack")
def paragraph_pack(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(chunk.paragraph_chunks(F.col("text"), 200)).alias("ord", "c")).select("doc_id", "ord", "c.tokens", F.md5("c.piece").alias("piece_md5"))


@query(
    "token_budget_prefix",
    r"""WITH t AS (SELECT source, doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS tokens FROM documents),
    r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t)
    SELECT source, doc_id, tokens, running FROM r WHERE running <= 20000""",
)
def token_budget_prefix(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.size(chunk.tokens(F.col("text"))).alias("tokens"))
    return ranking.budget_prefix(rows, "tokens", 20000, ["doc_id"], ["source"])


@query("unseen_docs", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("pending_docs", "SELECT doc_id, coalesce(quality, 0) AS processed FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def pending_docs(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.filter(~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", F.coalesce("quality", F.lit(0)).alias("processed"))


_TERMS = r"regexp_extract_all(lower({}), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"
_BM25 = f"""
d AS (SELECT doc_id, {_TERMS.format("text")} AS tok FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(tok)) AS avgdl FROM d WHERE len(tok) > 0),
tf AS (SELECT doc_id, len(tok) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tok, unnest(tok) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qf AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TERMS.format("query")}) AS term FROM asked) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) AS bm25
  FROM tf JOIN df USING (term) JOIN qf USING (term), n GROUP BY query_id, doc_id HAVING bm25 > 0)
"""


@query("term_statistics", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def term_statistics(spark, sf):
    return index.term_statistics(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "bm25_topk",
    f"""WITH asked AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25},
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, doc_id, bm25, rank FROM r WHERE rank <= 10""",
)
def bm25_topk(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = index.bm25(table(spark, sf, "documents"), asked).withColumn("bm25", F.round("bm25", 6))
    return ranking.top_k(scored, 10, [F.desc("bm25"), F.col("doc_id")], ["query_id"])


_COSINE = """
near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
nearest AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS INTEGER) AS pos FROM near WHERE cosine >= 0.2) WHERE pos <= {k})
"""


@query("cosine_topk", f"WITH {_COSINE.format(k=10)} SELECT query_id, doc_id AS vec_id, cosine, pos FROM nearest")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return index.cosine(vectors, vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _asked(spark, sf):
    """Queries: vectors whose id is divisible by 100, with the first 12 search tokens of their document as text."""
    docs = table(spark, sf, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(search_tokens(F.col("text")), 1, 12), " ").alias("query"))
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").select("query_id", "embedding").join(docs, "query_id")


_ASKED = f"asked AS (SELECT vec_id AS query_id, array_to_string({_TERMS.format('text')}[1:12], ' ') AS query FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 100 = 0)"
_HYBRID = f"""{_ASKED}, {_BM25}, {_COSINE.format(k=40)},
c AS (SELECT query_id, doc_id, cosine, CASE WHEN max(cosine) OVER w - min(cosine) OVER w < 1e-12 THEN 1.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END AS c
  FROM nearest JOIN asked USING (query_id) WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, doc_id, bm25, CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-12 THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS b,
  row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS pos FROM scored WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT coalesce(c.query_id, b.query_id) AS query_id, coalesce(c.doc_id, b.doc_id) AS doc_id, round(0.7 * coalesce(c, 0.0) + 0.3 * coalesce(b, 0.0), 6) AS fused, coalesce(cosine, 0.0) AS cosine, coalesce(bm25, 0.0) AS bm25
  FROM c FULL JOIN (SELECT * FROM b WHERE pos <= 40) b ON c.query_id = b.query_id AND c.doc_id = b.doc_id),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10)
"""


def hybrid_hits(spark, sf, k: int = 10):
    asked = _asked(spark, sf)
    near = index.cosine(table(spark, sf, "embeddings"), asked, index.POOL * k).withColumnRenamed("vec_id", "doc_id")
    said = index.bm25(table(spark, sf, "documents"), asked.select("query_id", "query"))
    return index.fuse(near, said, k, id_col="doc_id")


@query("hybrid_topk", f"WITH {_HYBRID} SELECT query_id, doc_id, fused, cosine, bm25, rank FROM hits")
def hybrid_topk(spark, sf):
    return hybrid_hits(spark, sf)


@query(
    "naive_context",
    rf"""WITH {_HYBRID}, r AS (
      SELECT query_id, rank, h.doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS tokens, text FROM hits h JOIN documents USING (doc_id)),
    s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM r)
    SELECT query_id, count(*) AS n_chunks, max(running) AS tokens, md5(string_agg({_STRIP.format("text")}, chr(10) || '--' || chr(10) ORDER BY rank)) AS context_md5 FROM s WHERE running <= 4000 GROUP BY query_id""",
)
def naive_context(spark, sf):
    """Q1: the texts of the best hits within a token budget, as one context per query."""
    docs = table(spark, sf, "documents").select("doc_id", strip("text").alias("content"), F.size(chunk.tokens(F.col("text"))).alias("tokens"))
    rows = hybrid_hits(spark, sf).select("query_id", "rank", "doc_id").join(docs, "doc_id")
    kept = ranking.budget_prefix(rows, "tokens", 4000, ["rank"], ["query_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n--\n")
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("running").alias("tokens"), F.md5(joined).alias("context_md5"))


@query(
    "multi_term_hits",
    f"""WITH {_HYBRID}, g AS (SELECT query_id % 300 AS ask, query_id AS pos, rank, doc_id, fused FROM hits),
    f AS (SELECT *, row_number() OVER (PARTITION BY ask, doc_id ORDER BY pos, rank) AS n FROM g),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ask ORDER BY pos, rank) AS INTEGER) AS place FROM f WHERE n = 1)
    SELECT ask, doc_id, pos, fused, place FROM k WHERE place <= 15""",
)
def multi_term_hits(spark, sf):
    """Q4: hits of several terms in a row, each document kept where it was first hit."""
    hits = hybrid_hits(spark, sf).select((F.col("query_id") % 300).alias("ask"), F.col("query_id").alias("pos"), "rank", "doc_id", "fused")
    first = ranking.keep_first(hits, ["ask", "doc_id"], ["pos", "rank"])
    return ranking.top_k(first, 15, ["pos", "rank"], ["ask"], "place").select("ask", "doc_id", "pos", "fused", "place")
