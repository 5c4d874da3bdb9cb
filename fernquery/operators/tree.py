"""Section trees: flattened to tables, numbered, levelled, and put together again."""

from __future__ import annotations

import json
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernquery.functions.text import strip
from fernquery.sources.scratch import stored

_CHILDREN = "array<variant>"


def is_structured(content):
    """Whether a text is a JSON object with a structure that is not empty."""
    v = F.try_parse_json(content)
    return F.coalesce(F.size(F.try_variant_get(v, "$.structure", _CHILDREN)) > 0, F.lit(False))


def flatten(docs: DataFrame, *, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """G1: sections of structured documents: ``(id, node_id, parent_path, path, depth, ord, title, summary, text, n_children)``.

    Children are in ``nodes``, else in ``children``; what is no object is left out. A
    section without a node_id is known by its path, of numbers from 1. One pass per
    level, however deep, each written before the next.
    """
    text = lambda k: F.coalesce(F.try_variant_get("node", f"$.{k}", "string"), F.lit(""))
    parsed = docs.filter(is_structured(F.col(content_col))).select(id_col, F.try_parse_json(content_col).alias("v"))
    front = parsed.select(id_col, F.array().cast("array<int>").alias("up"), F.posexplode(F.try_variant_get("v", "$.structure", _CHILDREN)).alias("ord", "node"))
    out = None
    for depth in count(1):
        under = F.coalesce(F.try_variant_get("node", "$.nodes", _CHILDREN), F.try_variant_get("node", "$.children", _CHILDREN))
        objects = F.filter(under, lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT")))
        level = front.filter(F.startswith(F.schema_of_variant("node"), F.lit("OBJECT"))).withColumn("path_array", F.array_append("up", F.col("ord") + 1))
        rows = level.select(
            id_col, text("node_id").alias("given"), F.array_join("up", ".").alias("parent_path"), F.array_join("path_array", ".").alias("path"), "path_array", F.lit(depth).alias("depth"), "ord", strip(text("title")).alias("title"),
            strip(F.when(text("summary") != "", text("summary")).otherwise(text("prefix_summary"))).alias("summary"), strip(text("text")).alias("text"), F.coalesce(F.when(under.isNotNull(), F.size(objects)), F.lit(0)).alias("n_children"), F.to_json(F.when(F.size(objects) > 0, objects)).alias("below"),
        )
        rows = stored(rows, "sections")
        out = rows.drop("below") if out is None else out.unionByName(rows.drop("below"))
        front = rows.filter("below is not null").select(id_col, F.col("path_array").alias("up"), F.posexplode(F.try_variant_get(F.parse_json("below"), "$", _CHILDREN)).alias("ord", "node"))
        if front.isEmpty():
            break
    return out.withColumn("node_id", F.when(strip("given") != "", strip("given")).otherwise(F.col("path"))).drop("given")


def preorder_ids(sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """Numbers in pre-order, from 0, padded to four digits. A path sorts before those below it."""
    return sections.withColumn("number", F.lpad((F.row_number().over(Window.partitionBy(by).orderBy("path_array")) - 1).cast("string"), 4, "0"))


def levels(sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """1 for a leaf, else one more than the highest child: the longest way down, from the paths below."""
    down = sections.select(by, "path_array", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("n"), "depth").select(by, F.array_join(F.slice("path_array", 1, F.col("n")), ".").alias("path"), "n", "depth")
    return down.groupBy(by, "path").agg((F.max("depth") - F.first("n") + 1).alias("level"))


def leaves(sections: DataFrame) -> DataFrame:
    """sections with text and without child objects."""
    return sections.filter("n_children = 0 and text <> ''")


def summaries(sections: DataFrame, level: int, most: int = 500) -> DataFrame:
    """Sections of one depth with their summary, else the start of their text."""
    return sections.filter(F.col("depth") == level).withColumn("shown", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.substring("text", 1, most)))


def from_list(items: DataFrame, by: str = "doc_id") -> DataFrame:
    """Parents of ``items(structure, …)`` by dotted prefix; one whose parent is not listed is a root."""
    parts = F.split("structure", r"\.")
    up = items.withColumn("wanted", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))
    known = items.select(F.col(by).alias("_d"), F.col("structure").alias("parent")).distinct()
    return up.join(known, (F.col(by) == F.col("_d")) & (F.col("wanted") == F.col("parent")), "left").drop("_d", "wanted")


def parents_by_level(items: DataFrame, by: str = "doc_id", order: str = "ord", level: str = "level") -> DataFrame:
    """The parent is the nearest earlier item of a smaller level."""
    a, b = items.alias("a"), items.select(F.col(by).alias("d"), F.col(order).alias("o"), F.col(level).alias("l")).alias("b")
    met = a.join(b, (F.col(f"a.{by}") == F.col("d")) & (F.col("o") < F.col(f"a.{order}")) & (F.col("l") < F.col(f"a.{level}")), "left")
    return met.groupBy(*[F.col(f"a.{c}") for c in items.columns]).agg(F.max("o").alias("parent_ord"))


def spans_by_level(items: DataFrame, end: int | str, by: str = "doc_id", start: str = "start", level: str = "level") -> DataFrame:
    """Each item ends where the next of the same or a higher rank begins, else at ``end``; items without a start are left out."""
    known = items.filter(F.col(start).isNotNull())
    b = known.select(F.col(by).alias("d"), F.col(start).alias("s"), F.col(level).alias("l"))
    met = known.join(b, (F.col(by) == F.col("d")) & (F.col("s") > F.col(start)) & (F.col("l") <= F.col(level)), "left")
    last = F.lit(end) if isinstance(end, int) else F.col(end)
    return met.groupBy(*known.columns).agg(F.min("s").alias("_next")).withColumn("stop", F.coalesce("_next", last)).drop("_next")


def spans_by_page(items: DataFrame, last_page, by: str = "doc_id", order: str = "ord") -> DataFrame:
    """An item ends on the next one's page, or on the page before if the next begins its page; the last at the document's end."""
    w = Window.partitionBy(by).orderBy(order)
    following = F.lead("page").over(w)
    end = F.when(following.isNull(), last_page).when(F.lead("appear_start").over(w) == "yes", following - 1).otherwise(following)
    return items.withColumn("end_page", F.greatest(end, F.col("page")))


def with_preface(items: DataFrame, by: str = "doc_id") -> DataFrame:
    """A first item where the listed ones begin after page 1."""
    first = items.groupBy(by).agg(F.min("page").alias("p")).filter("p > 1")
    return items.select(by, "structure", "title", "page").unionByName(first.select(by, F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("page")))


def page_texts(items: DataFrame, pages: DataFrame, by: str = "doc_id", tagged: bool = False) -> DataFrame:
    """The joined text of each item's pages, with page tags around each if ``tagged``."""
    t = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">\n"), F.col("text"), F.lit("\n<physical_index_"), F.col("page_no").cast("string"), F.lit(">\n")) if tagged else F.col("text")
    spread = items.select(by, "structure", F.explode(F.sequence("page", "end_page")).alias("page_no"))
    met = spread.join(pages, [by, "page_no"]).select(by, "structure", "page_no", t.alias("t"))
    return met.groupBy(by, "structure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda x: x["t"]), "").alias("text"))


def oversized(sections: DataFrame, pages: int, tokens: int) -> DataFrame:
    """Sections that span more pages and hold at least as many tokens as allowed."""
    return sections.filter((F.col("end_page") - F.col("page") + 1 > pages) & (F.col("tokens") >= tokens))


def with_summary(sections: DataFrame) -> DataFrame:
    """sections that have a summary."""
    return sections.filter(strip(F.coalesce("summary", F.lit(""))) != "")


def reshaped(content, remove: tuple[str, ...] = (), order: tuple[str, ...] = ()):
    """a JSON tree without the fields of ``remove``, at any depth, and with those of ``order`` first, in that order.

    What is no JSON stays as it is; null stays null.
    """

    def shaped(x):
        if isinstance(x, list):
            return [shaped(v) for v in x]
        if not isinstance(x, dict):
            return x
        kept = {k: shaped(v) for k, v in x.items() if k not in remove}
        return {k: kept[k] for k in (*(k for k in order if k in kept), *(k for k in kept if k not in order))}

    def one(text):
        try:
            return json.dumps(shaped(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return text

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())

    return run(content)


def nested(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, content)``: each document's sections as one JSON object again, children under ``nodes``, in the order of their paths.

    ``sections(id, path_array, node_id, title, summary, text)``; blank summaries and texts
    are left out. A section whose parent is missing stands below the nearest one above it.
    A pass over one document's sections in order, whose open ancestors are held.
    """

    def run(batches):
        current, first, roots, open_ = None, True, [], []

        def whole():
            return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([json.dumps({"structure": roots}, ensure_ascii=False)], pa.string())], names=["id", "content"])

        kind = pa.string()
        for b in batches:
            for doc, path, node, title, summary, text in zip(*(b[i].to_pylist() for i in range(6))):
                if first or doc != current:
                    if not first:
                        yield whole()
                    current, first, roots, open_ = doc, False, [], []
                section = {"title": title, "node_id": node} | {k: v for k, v in (("summary", summary), ("text", text)) if v}
                while open_ and path[: len(open_[-1][0])] != open_[-1][0]:
                    open_.pop()
                (open_[-1][1].setdefault("nodes", []) if open_ else roots).append(section)
                open_.append((path, section))
        if not first:
            yield whole()

    rows = sections.select(F.col(id_col).cast("string").alias("id"), "path_array", "node_id", "title", "summary", "text")
    return rows.repartition("id").sortWithinPartitions("id", "path_array").mapInArrow(run, "id string, content string").withColumnRenamed("id", id_col)
