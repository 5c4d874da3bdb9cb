"""Benchmark decontamination with a distributed positional inverted index.

The training side is a table of postings (term, document, position), stored in the
shared folder. Each part of it holds the postings of a share of the documents, as
document-partitioned search indexes do, so that building it moves no posting. Only
terms that some test item uses are stored; no other list could ever be read.

A phrase is looked up from its rarest terms: their lists, shifted by the terms'
offsets, are intersected first, and the remaining terms are verified only at the
places that are left, in the documents that are left. Proximity matches are found
from the two rarest terms in the same way.

Everything is DataFrame code. Phrases are taken in blocks of bounded size, so what is
broadcast is bounded too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernquery.llm.common import ascii_lower, stored

#: Fixed value: what separates words, given that A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct test terms up to which the vocabulary is broadcast; beyond, all postings are stored.
MAX_VOCABULARY = 500_000
#: Phrases looked up at a time.
BLOCK = 100_000
#: Documents with candidates up to which their ids are broadcast.
MAX_DOCUMENTS = 1_000_000
#: Terms whose lists are intersected before the rest is verified.
RAREST = 2
#: Fixed value: the term of the posting that ends a document. No word contains it.
END = "\0"


def words(text: Column) -> Column:
    """Split lower-cased text; a leading or trailing empty piece may remain."""
    return F.split(ascii_lower(text), BETWEEN)


def word_total(pieces: Column) -> Column:
    first = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(pieces) > 1) & (F.get(pieces, F.size(pieces) - 1) == ""), 1).otherwise(0)
    return F.when(pieces.isNull(), 0).otherwise(F.size(pieces) - first - last).cast("long")


def clean_words(text: Column) -> Column:
    return F.filter(F.coalesce(words(text), F.array().cast("array<string>")), lambda w: w != "")


def phrases(benchmark: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """Distinct test phrases: ``(phrase, terms, items)``.

    Windows of ``length`` consecutive words; an item of fewer words, but not none, is
    one window. items are the ids, as strings, of the items that hold the phrase.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.explode(F.array(clean_words(F.col(text_col)))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    windows = rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, length))).alias("terms"))
    return windows.groupBy("terms").agg(F.collect_set("item").alias("items")).select(F.xxhash64("terms").alias("phrase"), "terms", "items")


def postings(docs: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """``(term, doc, part, pos, n_words)`` of ``docs(doc, part, text)``, for the terms of ``vocabulary`` or all.

    Each document also has one posting of the term END, so that the index holds every
    document and its length. Positions are consistent within a document; they start at
    1 where the text begins with a separator.
    """
    pieces = docs.select("doc", "part", F.coalesce(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    out = pieces.select("doc", "part", word_total(F.col("w")).alias("n_words"), F.posexplode(F.array_append("w", F.lit(END))).alias("pos", "term"))
    if vocabulary is None:
        return out.filter("term <> ''").select("term", "doc", "part", "pos", "n_words")
    return out.join(F.broadcast(vocabulary), "term", "left_semi").select("term", "doc", "part", "pos", "n_words")


def _ranked(block: DataFrame, counts: DataFrame) -> DataFrame:
    """Terms of each phrase by rarity: ``(phrase, length, rank, term, offset)``; phrases with a term that no document has are dropped."""
    terms = block.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    w = Window.partitionBy("phrase")
    return terms.withColumn("known", F.count(F.lit(1)).over(w)).filter("known = length").withColumn("rank", F.row_number().over(w.orderBy("n", "term", "offset"))).drop("known", "n")


def _candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Places where the rarest terms of a phrase stand at their offsets: ``(doc, part, phrase, start, length)``."""
    lists = F.broadcast(ranked.filter(F.col("rank") <= RAREST))
    shifted = index.join(lists, "term").select("doc", "part", "phrase", (F.col("pos") - F.col("offset")).alias("start"), "length", F.expr("shiftleft(1, rank - 1)").alias("bit"))
    met = shifted.groupBy("doc", "part", "phrase", "start", "length").agg(F.bit_or("bit").alias("met"))
    return met.filter(F.col("met") == F.expr(f"shiftleft(1, least(length, {RAREST})) - 1")).drop("met")


def phrase_matches(index: DataFrame, block: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact occurrences ``(doc, part, phrase, start, length)`` of one block's phrases, each once."""
    ranked = stored(_ranked(block, counts), "ranked")
    found = stored(_candidates(index, ranked), "candidates")
    due = found.join(F.broadcast(ranked.filter(F.col("rank") > RAREST).select("phrase", "term", "offset")), "phrase")
    due = due.select("doc", "part", "phrase", "start", "length", (F.col("start") + F.col("offset")).alias("pos"), "term")
    holders = found.select("doc", "part").distinct()
    if holders.count() <= MAX_DOCUMENTS:
        holders = F.broadcast(holders)
    near = index.select("doc", "part", "term", "pos").join(holders.toDF("h_doc", "h_part"), (F.col("part") == F.col("h_part")) & F.col("doc").eqNullSafe(F.col("h_doc")), "left_semi").distinct().toDF("p_doc", "p_part", "p_term", "p_pos")
    same = (F.col("part") == F.col("p_part")) & (F.col("pos") == F.col("p_pos")) & (F.col("term") == F.col("p_term")) & F.col("doc").eqNullSafe(F.col("p_doc"))
    full = due.join(near, same).groupBy("doc", "part", "phrase", "start", "length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("length") - RAREST).drop("n")
    return full.unionByName(found.filter(F.col("length") <= RAREST))


def proximity_matches(index: DataFrame, block: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Places where the two rarest terms of a phrase stand within ``window`` words, in any order.

    Returns ``(doc, part, phrase, start, stop)``, the positions of the two terms. A
    phrase of one term matches wherever that term stands.
    """
    ranked = stored(_ranked(block, counts), "ranked")
    lists = ranked.filter("rank <= 2").select("phrase", "length", "rank", "term")
    at = index.join(F.broadcast(lists), "term").select("doc", "part", "phrase", "length", "rank", "pos", F.floor(F.col("pos") / (window + 1)).alias("cell")).distinct()
    one = at.filter("rank = 1")
    alone = one.filter("length = 1").select("doc", "part", "phrase", F.col("pos").alias("start"), F.col("pos").alias("stop"))
    probe = one.filter("length > 1").select("doc", "part", "phrase", F.col("pos").alias("a"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    other = at.filter("rank = 2").select(F.col("doc").alias("o_doc"), F.col("part").alias("o_part"), F.col("phrase").alias("o_phrase"), F.col("pos").alias("b"), F.col("cell").alias("o_cell"))
    near = probe.join(other, (F.col("part") == F.col("o_part")) & (F.col("phrase") == F.col("o_phrase")) & (F.col("cell") == F.col("o_cell")) & F.col("doc").eqNullSafe(F.col("o_doc")))
    near = near.filter((F.abs(F.col("a") - F.col("b")) <= window) & (F.col("a") != F.col("b"))).select("doc", "part", "phrase", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("stop"))
    return alone.unionByName(near)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("part"), F.col(text_col).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10) -> DataFrame:
    """How much of each document stands in the benchmark.

    Returns one row per input row: id, ``n_words``, ``n_hit`` (words inside any
    occurrence of a test phrase), ``items`` (sorted ids, as strings, of the test items
    with occurring phrases), ``part`` (tells apart rows that share an id).

    Null and empty texts have no words and no hits; a null id is an id like any other;
    repeated rows get equal rows each; items with equal texts are all listed; an item
    with a null id is not listed, though its phrases are hits. With an empty benchmark
    nothing is hit. Other columns of either table are not looked at.
    """
    tests = stored(phrases(benchmark, item_col, item_text_col, length), "phrases")
    terms = tests.select(F.explode("terms").alias("term")).distinct()
    total, n_terms = tests.count(), terms.count()
    vocabulary = terms.union(docs.sparkSession.createDataFrame([(END,)], "term string")) if n_terms <= MAX_VOCABULARY else None
    index = stored(postings(_keyed(docs, id_col, text_col), vocabulary), "postings")
    counts = index.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # added up in the tasks first
    counts = stored(counts if vocabulary is not None else counts.join(terms, "term", "left_semi"), "term_counts")
    n_blocks = max(1, -(-total // BLOCK))
    found = stored(reduce(DataFrame.unionByName, (phrase_matches(index, tests.filter(F.pmod("phrase", F.lit(n_blocks)) == b), counts) for b in range(n_blocks))), "matches")

    spans = found.select("doc", "part", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    order = Window.partitionBy("doc", "part").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("seen", F.max("stop").over(order)).select("doc", "part", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("seen", "start"))).alias("n"))
    hits = covered.groupBy("doc", "part").agg(F.sum("n").cast("long").alias("n_hit")).toDF("h_doc", "h_part", "n_hit")
    named = found.select("doc", "part", "phrase").distinct().join(tests.select("phrase", F.explode("items").alias("item")), "phrase")
    items = named.groupBy("doc", "part").agg(F.sort_array(F.collect_set("item")).alias("items")).toDF("i_doc", "i_part", "items")
    whole = index.filter(F.col("term") == END).select("doc", "part", "n_words")
    out = whole.join(hits, (F.col("part") == F.col("h_part")) & F.col("doc").eqNullSafe(F.col("h_doc")), "left")
    out = out.join(items, (F.col("part") == F.col("i_part")) & F.col("doc").eqNullSafe(F.col("i_doc")), "left")
    return out.select(F.col("doc").alias(id_col), "part", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 10) -> DataFrame:
    """The documents without any occurrence of a test phrase, whole rows, repeated rows included."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, length=length).filter("n_hit > 0").select(F.col(id_col).alias("b_id"), F.col("part").alias("b_part")).distinct()
    part = F.xxhash64(docs[text_col], docs[text_col].isNull())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["b_id"]) & (part == bad["b_part"]), "left_anti")
