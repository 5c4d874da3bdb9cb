"""Streams: files of documents taken in as they come, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.operators import chunk
from fernquery.sources.scratch import fresh_path


def _stream(spark: SparkSession, source: str) -> DataFrame:
    """A stream of a folder's files, or of a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if store.getFileStatus(path).isDirectory():
        return reader.parquet(source)
    folder, _, name = source.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def ingest(spark: SparkSession, source: str, target: str, state: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> None:
    """chunk the documents of new files of ``source`` that ``target`` doesn't hold yet, until all are taken in.

    A batch that is run again writes to the same place, and ids that are there already are
    left out, so replays change nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = chunk.token_windows(batch.dropDuplicates(["doc_id"]), size, overlap)
        known = [p for p in _parts(spark, target) if not p.endswith(f"/batch={number}")]
        if known:
            rows = rows.join(spark.read.parquet(*known).select("doc_id").distinct(), "doc_id", "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    _stream(spark, source).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _parts(spark: SparkSession, target: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().toString() for s in store.listStatus(path)] if store.exists(path) else []


def ingest_twice(spark: SparkSession, source: str) -> DataFrame:
    """The chunk table after the same files were taken in by two streams, the second of which finds nothing new."""
    target = fresh_path(spark, "chunks")
    for _ in range(2):
        ingest(spark, source, target, fresh_path(spark, "state"))
    return spark.read.schema("doc_id long, ord int, tokens int, content string, chunk_id string").parquet(*_parts(spark, target))


def window_counts(spark: SparkSession, source: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and type, as a stream with a watermark sees them when all files are read."""
    target = fresh_path(spark, "windows")
    rows = _stream(spark, source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    flat = counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(target)
    flat.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(target)
