"""Quality rules: repetition within a document, and lines that many documents of a host share.

Both parts are DataFrame code. Repetition is measured inside the row, without a
shuffle: three-word windows are hashed (64 bits), the hashes are sorted with their
positions, and equal neighbours are windows found twice. Line frequency counts, for
each host and normalised line, the distinct texts that hold the line; each text
contributes a line once, so the count is a plain sum that is combined before the
shuffle, and copies of one page don't make their lines look like boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.llm.common import stored

#: Fixed values of the rules.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is above the limit in a host if more than this share of the host's distinct texts hold it, and more than LEAST_TEXTS.
LINE_SHARE, LEAST_TEXTS = 0.02, 10
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
#: Lines above the limit up to which they are broadcast.
MAX_LINES = 500_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """Words; null for null. White space at the ends is removed first, so only '' gives an empty piece."""
    return F.split(F.regexp_replace(text, rf"^{SPACES}|{SPACES}\z", ""), SPACES)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more, the first included."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        keyed = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(keyed), starts)

    def starts(s: Column) -> Column:
        n = F.size(s)
        following = F.concat(F.slice(s, 2, n), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, n - 1))
        same_next = F.zip_with(s, following, lambda a, b: F.when(a["h"] == b["h"], a["i"]))
        same_last = F.zip_with(s, before, lambda a, b: F.when(a["h"] == b["h"], a["i"]))
        found = F.sort_array(F.array_distinct(F.array_compact(F.concat(same_next, same_last))))
        return let(found, covered)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda x, y: x + y))

    return F.when(F.size(words) < 3, 0).otherwise(let(words, windows)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Counts of one whole text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = pieces(text)
    n_words = F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": n_words,
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def line_hash(host: Column, line: Column) -> Column:
    """Hash of a host and a normalised line."""
    return F.xxhash64(host, host.isNull(), line)


def line_hashes(host: Column, text: Column) -> Column:
    """Distinct ``(h, words)`` of a text's lines: hash of host and normalised line, and the words on all lines like it."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normalised), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(line_hash(host, x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def without_lines(host: Column, text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in ``gone``; as it is where that is null."""
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, line_hash(host, normalised(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def common_lines(docs: DataFrame, host_col: str, text_col: str, share: float, least: int) -> DataFrame:
    """Hashes ``h`` of the lines above the limit in their host."""
    texts = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    held = texts.select("host", "t", F.explode(F.array_distinct(F.transform(line_hashes(F.col("host"), F.col("text")), lambda x: x["h"]))).alias("h"))
    return _frequent(texts, held, share, least)


def _frequent(texts: DataFrame, held: DataFrame, share: float, least: int) -> DataFrame:
    # Lines that are in few rows are in few texts: only the others need their texts counted.
    limits = texts.groupBy("host", "t").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("n_texts"))
    limits = limits.select(F.col("host").alias("l_host"), F.greatest(F.lit(least).cast("double"), share * F.col("n_texts")).alias("limit"))
    rows = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = rows.join(F.broadcast(limits), F.col("host").eqNullSafe(F.col("l_host"))).filter("n > limit").select("h", "limit")
    often = stored(often, "often_lines")
    few = F.broadcast(often) if often.count() <= MAX_LINES else often
    counted = held.join(few, "h").groupBy("h", "limit", "t").agg(F.lit(1).alias("one")).groupBy("h", "limit").agg(F.count("one").alias("n"))
    return counted.filter("n > limit").select("h")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = LINE_SHARE, least_texts: int = LEAST_TEXTS, left_share: float = LEFT_SHARE) -> DataFrame:
    """Every input row with its measures and verdict; the input's columns are not returned but for the id.

    Columns: id, ``part`` (tells apart rows that share an id), ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``common_words`` (words on lines above the limit), ``depleted``, ``kept``.

    A null text has no words and fails; a null host is a host of its own; a null id is
    an id like any other; repeated rows get equal rows each, and count once in line
    frequencies, as do documents of one host with equal texts.
    """
    return _verdicts(docs, _lost(docs, id_col, text_col, host_col, line_share, least_texts).drop("gone"), id_col, text_col, host_col, left_share)


def _part(text_col: str, host_col: str) -> Column:
    return F.xxhash64(F.col(text_col), F.col(text_col).isNull(), F.col(host_col), F.col(host_col).isNull())


def _lost(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_share: float, least_texts: int) -> DataFrame:
    """``(c_id, c_part, common_words, gone)`` of the rows with lines above the limit: words on them, and their hashes."""
    common = stored(common_lines(docs, host_col, text_col, line_share, least_texts), "common_lines")
    few = F.broadcast(common) if common.count() <= MAX_LINES else common
    lines = docs.select(F.col(id_col).alias("c_id"), _part(text_col, host_col).alias("c_part"), F.posexplode(line_hashes(F.col(host_col), F.col(text_col))).alias("pos", "line"))
    hit = lines.select("c_id", "c_part", "pos", F.col("line.h").alias("h"), F.col("line.words").alias("words")).join(few, "h", "left_semi")
    hit = hit.groupBy("c_id", "c_part", "pos").agg(F.max("words").alias("words"), F.max("h").alias("h"))
    return hit.groupBy("c_id", "c_part").agg(F.sum("words").cast("long").alias("common_words"), F.collect_set("h").alias("gone"))


def _verdicts(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, host_col: str, left_share: float) -> DataFrame:
    rows = docs.select(F.col(id_col), _part(text_col, host_col).alias("part"), *(v.alias(k) for k, v in measures(F.col(text_col)).items()))
    out = rows.join(lost, rows[id_col].eqNullSafe(F.col("c_id")) & (F.col("part") == F.col("c_part")), "left").drop("c_id", "c_part")
    out = out.withColumn("common_words", F.coalesce("common_words", F.lit(0)).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("common_words") < left_share * F.col("n_words")
    return out.withColumns({"base_failed": base, "depleted": depleted, "kept": ~base & ~depleted})


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = LINE_SHARE, least_texts: int = LEAST_TEXTS, left_share: float = LEFT_SHARE) -> DataFrame:
    """The documents that the rules keep, repeated rows included, their texts without the lines above the limit; other columns as they are."""
    lost = stored(_lost(docs, id_col, text_col, host_col, line_share, least_texts), "lost_lines")
    bad = _verdicts(docs, lost.drop("gone"), id_col, text_col, host_col, left_share).filter("not kept").select(F.col(id_col).alias("b_id"), F.col("part").alias("b_part")).distinct()
    part = F.xxhash64(docs[text_col], docs[text_col].isNull(), docs[host_col], docs[host_col].isNull())
    kept = docs.join(bad, docs[id_col].eqNullSafe(bad["b_id"]) & (part == bad["b_part"]), "left_anti")
    cut = lost.select(F.col("c_id").alias("_c_id"), F.col("c_part").alias("_c_part"), F.col("gone").alias("_gone"))
    kept = kept.join(cut, docs[id_col].eqNullSafe(cut["_c_id"]) & (part == cut["_c_part"]), "left")
    text = without_lines(docs[host_col], docs[text_col], cut["_gone"]).alias(text_col)
    return kept.select(*(text if c == text_col else docs[c] for c in docs.columns))
