"""Thin queries: each applies one operator to its whole table and returns its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm import chat, decontaminate, mixing, ngram_lm, quality_model, quality_rules, simhash, toxicity, url_rules, warc
from fernquery.llm.common import crc_mod, stored, table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, segments=2)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score_all(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, max_repeats=3).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return warc.read_archives(archives.repartition(spark.sparkContext.defaultParallelism)).select(number("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = chat.read_back(stored(chat.format_chats(turns.unionByName(extra)), "chats"))
    return found.withColumnRenamed("conv", "conv_id")


#: The listed rules (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules=URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "mined")


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    model, scored = ngram_lm.train_and_score(docs, ~F.col("held_out"), min_count=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "common_words")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), quality_model.score_all(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_toxicity": op2_toxicity, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash, "op5_warc": op5_warc, "op6_chat": op6_chat, "op7_url_rules": op7_url_rules, "op8_ngram_lm": op8_ngram_lm, "op9_quality_rules": op9_quality_rules, "op10_quality_model": op10_quality_model}

_OP1_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (SELECT DISTINCT item, w[s:s + 9] AS terms FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
len AS (SELECT DISTINCT len(terms) AS n FROM win),
part AS (SELECT doc_id, s, n, w[s:s + n - 1] AS terms FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, len WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, item FROM part JOIN win USING (terms)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM line WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, source, text, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM line),
limits AS (SELECT source, greatest(10.0, 0.02 * count(DISTINCT text)) AS most FROM d GROUP BY source),
often AS (SELECT source, l FROM norm JOIN limits USING (source) WHERE l <> '' GROUP BY source, l, most HAVING count(DISTINCT text) > most),
lost AS (SELECT doc_id, CAST(sum(length(l) - length(replace(l, ' ', '')) + 1) AS BIGINT) AS n FROM norm JOIN often USING (source, l) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS common_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words - common_words < 0.3 * n_words) AS kept, common_words
FROM b
"""

_OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
bits AS (SELECT page_id, octet_length(b) AS n, first, h FROM p JOIN f USING (h)),
b32 AS (
  SELECT page_id, n, first, h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY i) AS digest
  FROM (
    SELECT page_id, n, first, h, i, CAST((CAST(concat('0x', substr(h, 1 + 10 * (i // 8), 10)) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) AS v
    FROM bits, range(32) r(i))
  GROUP BY page_id, n, first, h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b32
"""

_OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last,
    length(text) + length(text) - length(replace(text, chr(92), '')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 ELSE 9 END
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '[SYS]', ''))) // 5 + (length(text) - length(replace(text, '[/SYS]', ''))) // 6
    + (length(text) - length(replace(text, '[ROLE]', ''))) // 6 + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
    + (length(text) - length(replace(text, '[/TURN]', ''))) // 7 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before <> 'user' WHEN 'assistant' THEN before = 'user' ELSE false END)
    AND bool_or(last AND role = 'assistant') AS valid
FROM c GROUP BY conv_id
"""

ORACLES = {"op6_chat": _OP6_SQL, "op5_warc": _OP5_SQL, "op1_decontaminate": _OP1_SQL, "op9_quality_rules": _OP9_SQL}
