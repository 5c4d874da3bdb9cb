"""Queries over streams and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernquery.operators import usage
from fernquery.plans.registry import query
from fernquery.plans.retrieval import _CHUNKS
from fernquery.sources.tables import table
from fernquery.streaming import ingest


@query("incremental_ingest", f"WITH {_CHUNKS.format(size=1200, step=1100)} SELECT doc_id, ord, tokens, concat('chunk-', md5(content)) AS chunk_id FROM chunks")
def incremental_ingest(spark, sf):
    return ingest.ingest_twice(spark, f"{sf}/documents.parquet").select("doc_id", "ord", "tokens", "chunk_id")


@query("event_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    rows = ingest.window_counts(spark, f"{sf}/events.parquet")
    return rows.select(F.col("start").cast("long").alias("start_s"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "usage_rollup",
    """WITH c AS (SELECT event_type AS stage, concat('m', user_id % 3) AS model, concat('s', user_id % 2) AS source, greatest(CAST(event_id % 100 AS BIGINT) - 5, 0) AS p, CAST(event_id % 7 AS BIGINT) AS c, event_id % 2 = 0 AS t FROM events),
    x AS (SELECT stage, model, source, p, c, CASE WHEN t THEN 50 ELSE p + c END AS t FROM c)
    SELECT stage, model, source, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS calls,
      CASE GROUPING(stage, model, source) WHEN 7 THEN 'all' WHEN 3 THEN 'stage' WHEN 1 THEN 'model' ELSE 'source' END AS grain
    FROM x GROUP BY GROUPING SETS ((stage), (stage, model), (stage, source), ())""",
)
def usage_rollup(spark, sf):
    e = table(spark, sf, "events")
    calls = e.select(F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("source"), (F.col("event_id") % 100 - 5).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), F.when(F.col("event_id") % 2 == 0, 50).alias("total_tokens"))
    return usage.rollup(calls)
