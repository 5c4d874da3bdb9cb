"""Tables of contents: page offsets, gaps, clean-up, and finding titles in lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fernquery.functions.text import squeezed, strip, structure_key
from fernquery.operators.ranking import top_k


def page_offset(pairs: DataFrame, by: str) -> DataFrame:
    """The most frequent difference of physical and printed page; of equally frequent ones the first seen."""
    rows = pairs.select(by, "ord", (F.col("physical") - F.col("page")).alias("offset")).filter("offset is not null")
    counts = rows.groupBy(by, "offset").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return top_k(counts, 1, [F.desc("n"), "first"], [by], "_n").select(by, "offset", "n")


def with_offset(items: DataFrame, offsets: DataFrame, by: str) -> DataFrame:
    """Physical page = page + offset."""
    return items.join(offsets.select(by, "offset"), by, "left").withColumn("physical", F.col("page") + F.col("offset")).drop("page", "offset")


def within_pages(page: Column, last: Column) -> Column:
    """null beyond the document's end."""
    return F.when(page <= last, page)


def nearest_known(items: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """Nearest page before and after each item, from items that are not known to be wrong."""
    good = F.when(~F.col("wrong"), F.col("page"))
    w = Window.partitionBy(by).orderBy(order)
    before = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(good, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return items.withColumns({"before": before, "after": after})


def page_range(text: str, last: int) -> list[int]:
    """Pages of ``a-b`` or ``a:b``, within 1 and ``last``; ValueError where it is no range."""
    a, sep, b = text.replace(":", "-").partition("-")
    if not sep or not a.strip().isdigit() or not b.strip().isdigit() or int(a) > int(b):
        raise ValueError(f"not a range of pages: {text!r}")
    return list(range(max(1, int(a)), min(last, int(b)) + 1))


def clean_items(items: DataFrame, by: str) -> DataFrame:
    """Trimmed, blanks and repeats dropped, in the order of dotted numbers, which ``place`` tells."""
    rows = items.select(by, strip("structure").alias("structure"), strip("title").alias("title")).filter("structure <> '' and title <> ''").dropDuplicates([by, "structure", "title"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(structure_key(F.col("structure")), "structure", "title")))


def matching_pairs(listed: DataFrame, found: DataFrame, by: str, start: int) -> DataFrame:
    """Page pairs of equal titles, found on page ``start`` or later."""
    return listed.join(found.withColumnRenamed("page", "physical"), [by, "title"]).filter(F.col("physical") >= start)


def title_candidates(titles: DataFrame, lines: DataFrame, by: str, most: int = 6) -> DataFrame:
    """Up to ``most`` lines per title that hold it, or that it holds, white space and case aside; the earliest first.

    Titles meet the lines of their own document only.
    """
    t = titles.select(by, "title", squeezed(F.col("title")).alias("t")).filter("t <> ''")
    rows = lines.select(by, "line_no", squeezed(F.col("line")).alias("x")).filter("x <> ''")
    met = rows.join(t, by).filter(F.contains("x", F.col("t")) | F.contains("t", F.col("x")))
    return top_k(met.select(by, "title", "line_no"), most, ["line_no"], [by, "title"], "pos")


def assign_in_order(candidates: DataFrame, by: str) -> DataFrame:
    """For each title in turn the first verified candidate at or past the cursor, else the first candidate there; the cursor moves past it.

    ``candidates(by, ord, title, lines array<int>, verified array<boolean>)``. A fold over
    one document's titles; titles without such a candidate get null.
    """
    schema = pa.schema([("doc", pa.string()), ("ord", pa.int64()), ("title", pa.string()), ("line_no", pa.int64())])

    def run(batches):
        current, cursor = object(), 0
        for b in batches:
            out = []
            for doc, order, title, lines, verified in zip(*(b[c].to_pylist() for c in ("doc", "ord", "title", "lines", "verified"))):
                if doc != current:
                    current, cursor = doc, 0
                able = [(n, v) for n, v in zip(lines or [], verified or []) if n >= cursor]
                pick = next((n for n, v in able if v), able[0][0] if able else None)
                cursor = cursor if pick is None else pick + 1
                out.append((doc, order, title, pick))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    rows = candidates.select(F.col(by).cast("string").alias("doc"), F.col("ord").cast("long").alias("ord"), "title", "lines", "verified")
    return rows.repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, "doc string, ord long, title string, line_no long")


def page_groups(pages: DataFrame, most: int, overlap: int = 1, by: str = "doc_id") -> DataFrame:
    """Pages in groups of about equal size up to ``most`` tokens, each beginning with the last ``overlap`` pages of the one before; no group is empty."""
    schema = pa.schema([("doc", pa.string()), ("page_no", pa.int64()), ("group_no", pa.int64())])

    def grouped(sizes: list[int]) -> list[list[int]]:
        total = sum(sizes)
        if total <= most:
            return [list(range(len(sizes)))]
        parts = -(-total // most)
        target = -(-(total + most * parts) // (2 * parts))  # half-way between the mean and the most, rounded up
        out, held, size = [], [], 0
        for i, n in enumerate(sizes):
            if held and size + n > target:
                out.append(held)
                held = list(range(max(i - overlap, 0), i))
                size = sum(sizes[j] for j in held)
            held = [*held, i]
            size += n
        return [*out, held]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc"].to_pylist(), table["page_no"].to_pylist(), table["tokens"].to_pylist()), key=lambda r: r[1])
        out = [(rows[i][0], rows[i][1], g) for g, part in enumerate(grouped([r[2] for r in rows])) for i in part]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = pages.select(F.col(by).cast("string").alias("doc"), F.col("page_no").cast("long").alias("page_no"), F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("doc").applyInArrow(run, "doc string, page_no long, group_no long")


def accuracy(checks: DataFrame, by: str) -> DataFrame:
    """Share of checked titles that were found."""
    return checks.groupBy(by).agg(F.avg((F.col("answer") == "yes").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("checked"))


def outline_numbers(items: DataFrame, by: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """Dotted numbers from outline levels, however deep: a counter per level, deeper counters begin again.

    A pass over one document's items in order; a level that was skipped counts 0. Items
    without a level, or of level 0 or less, have no number and count nothing.
    """
    where = [items.columns.index(c) for c in (by, level)]

    def run(batches):
        current, counters = object(), []
        for b in batches:
            out = []
            for doc, n in zip(b[where[0]].to_pylist(), b[where[1]].to_pylist()):
                if doc != current:
                    current, counters = doc, []
                if n is None or n < 1:
                    out.append(None)
                    continue
                counters = counters[:n] + [0] * (n - len(counters))
                counters[-1] += 1
                out.append(".".join(map(str, counters)))
            yield b.append_column("structure", pa.array(out, pa.string()))

    schema = StructType([*items.schema.fields, StructField("structure", StringType())])
    return items.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)
