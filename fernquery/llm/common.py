"""Shared helpers: table access, intermediate tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.sources.scratch import fresh_path

#: The characters that separate words in most contracts, as a Java class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows that share a key from which they are joined where they are; such keys up to which the other side's rows for them are broadcast.
HOT_ROWS, MAX_HOT = 1000, 500_000


def joined(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Inner join on ``key``, where ``right`` has each key once, and ``counts(key, n)`` says how many rows of ``left`` a key has.

    Rows of a key that HOT_ROWS or more share are not gathered in one task: the row of ``right``
    for such a key is broadcast. There are no more of those than a thousandth of the rows.
    """
    hot = stored(right.join(counts.filter(F.col("n") >= HOT_ROWS).select(key), key), "hot_rows")
    if not 0 < hot.count() <= MAX_HOT:
        return left.join(right, key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return rest.unionByName(left.join(F.broadcast(hot), key).select(rest.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone: other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(ident: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % mod


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` (long ids): ``(node, root)``.

    root is the smallest id of the component. Large-star and small-star rounds
    run as joins and minima, so no neighbourhood is ever gathered in a task; each
    round is written to the shared folder. Nodes without edges are not returned.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def canonical(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = stored(canonical(edges), "edges")
    before = mark(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = canonical(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        following = stored(canonical(star.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))), "edges")
        drop_stored(current)
        current, after = following, mark(following)
        if after == before:
            break
        before = after
    root = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    own = current.select(F.col("v").alias("node")).distinct().join(root.select("node"), "node", "left_anti")
    return root.unionByName(own.select("node", F.col("node").alias("root")))
