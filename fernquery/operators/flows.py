"""Flows around a model: indexing end to end, decomposition of queries, answers from leaves, tables of contents from text.

Calls go through providers, as in ``models``; what is done with the replies are joins and groupings.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernquery.functions import json_salvage
from fernquery.functions.text import relation_pairs, squeezed, strip
from fernquery.operators import extract, graph, models
from fernquery.operators.ranking import budget_prefix
from fernquery.sources.scratch import stored


def index_chunks(chunks: DataFrame, make: models.Complete, *, rounds: int = 1, more: str = "MORE", check: str = "ENOUGH?", level: int = 0) -> tuple[DataFrame, DataFrame]:
    """M7: ``(nodes, edges)`` of ``chunks(chunk_id, content)``: extraction with continuations, parsing, merging, and nodes for ends that no record describes.

    Equal chunks share an id and count once. The replies are written before they are parsed,
    so that a lost executor asks for its own prompts again and for no others'.
    """
    prompts = chunks.groupBy("chunk_id").agg(F.min("content").alias("content"))
    replies = stored(extract.glean_all(prompts, make, rounds, more, check, key_col="chunk_id", prompt_col="content"), "extraction")
    parsed = extract.records(replies, key_col="chunk_id").withColumnRenamed("chunk_id", "source_id")
    nodes = graph.merge_nodes(extract.entities(parsed).withColumn("level", F.lit(level)))
    edges = graph.merge_edges(extract.relations(parsed).withColumn("level", F.lit(level)))
    return nodes.unionByName(graph.implicit_endpoints(nodes, edges), allowMissingColumns=True), edges


def repaired(facts: DataFrame, again: DataFrame, sources: DataFrame) -> DataFrame:
    """``facts`` with those of ``sources(source_id)`` replaced by the facts that were extracted ``again``; a source that gives nothing the second time keeps its old ones."""
    new = again.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return facts.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new.select(*facts.columns))


def decompose(queries: DataFrame, make: models.Complete, *, key: str = "query_id", text: str = "text", macro: bool = True) -> DataFrame:
    """``(key, entities, relations, questions)`` of each query, from one reply of JSON; ``macro`` false leaves the questions out.

    Relations are written with arrows and come as pairs of ends. A reply that is no JSON gives empty lists.
    """
    said = extract.complete_all(queries, make, key_col=key, prompt_col=text)
    read = json_salvage.salvaged(F.col("response"))

    def listed(name: str) -> Column:
        raw = F.get_json_object(read, f"$.{name}")
        parts = F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))
        return F.array_distinct(F.filter(F.transform(parts, strip), lambda t: t.isNotNull() & (t != "")))

    ends = F.flatten(F.transform(listed("relations"), relation_pairs))
    return said.select(key, listed("entities").alias("entities"), ends.alias("relations"), (listed("questions") if macro else F.array().cast("array<string>")).alias("questions"))


def answer_leaves(leaves: DataFrame, questions: DataFrame, make: models.Complete, *, by: str, most: int, least: int = 512, nothing: str = "none") -> DataFrame:
    """``(by, question, answer)``: each question of a document asked over its leaves in order, as far as ``max(least, most)`` tokens go.

    ``leaves(by, ord, text)``, ``questions(by, question)``. Blank leaves take no part; an
    answer that says ``nothing`` is null. A document's leaves meet its questions after they
    have been cut and joined, so that a text is there once per question.
    """
    told = leaves.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("_t", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)))
    kept = budget_prefix(told, "_t", max(least, most), ["ord"], [by])
    context = kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("_c"))
    ask = questions.select(by, "question").distinct().join(context, by)
    ask = ask.select(F.to_json(F.struct(by, "question")).alias("_k"), by, "question", F.concat_ws("\n", "question", "_c").alias("_p"))
    said = extract.complete_all(ask, make, key_col="_k", prompt_col="_p").select("_k", strip("response").alias("answer"))
    return ask.drop("_p").join(said, "_k").select(by, "question", F.when(~F.lower("answer").isin("", nothing), F.col("answer")).alias("answer"))


def path_relations(paths: DataFrame, key: list[str]) -> DataFrame:
    """The steps of ``paths(key…, path)`` as evidence ``(key…, src_node_id, dst_node_id, pos)``, ends in order; a path of no edges has none."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    rows = paths.filter(F.size("path") > 1).select(*key, F.posexplode(steps).alias("pos", "s"))
    return rows.select(*key, F.least("s.a", "s.b").alias("src_node_id"), F.greatest("s.a", "s.b").alias("dst_node_id"), "pos")


def title_checks(items: DataFrame, pages: DataFrame, make: models.Complete, *, by: str, starts: bool = False) -> DataFrame:
    """``items(by, ord, title, page)`` with ``answer``: does the title appear on its page (``starts``: does the page begin with it)?

    A page that holds the title literally, white space and case aside, needs no model; an
    item without a page, or whose page is missing, is answered no.
    """
    met = items.join(pages.select(by, F.col("page_no").alias("page"), "text"), [by, "page"], "left")
    t, x = squeezed(F.col("title")), squeezed(F.col("text"))
    plain = F.coalesce((t != "") & (F.startswith(x, t) if starts else F.contains(x, t)), F.lit(False))
    met = met.withColumn("_k", F.to_json(F.struct(by, "ord"))).withColumn("_plain", plain)
    question = F.lit("Does the page begin with this title?" if starts else "Does this title appear on the page?")
    open_ = met.filter(~F.col("_plain") & F.col("text").isNotNull()).select("_k", F.concat_ws("\n", question, "title", "text").alias("_p"))
    said = extract.complete_all(open_, make, key_col="_k", prompt_col="_p").select("_k", F.lower(strip("response")).alias("_a"))
    return met.join(said, "_k", "left").select(by, "ord", "title", "page", F.when(F.col("_plain") | (F.col("_a") == "yes"), "yes").otherwise("no").alias("answer"))


def best_attempts(attempts: DataFrame, by: str, accept: float = 1.0, mend: float = 0.6) -> DataFrame:
    """Of ``attempts(by, step, accuracy)``, tried in order of ``step``, the first that is accurate enough, with what to do: accept it, or mend its wrong items.

    From ``accept`` on an attempt is taken as it is, above ``mend`` it is mended; where none
    reaches that, the last one is taken as it is, marked ``last``.
    """
    able = F.when((F.col("accuracy") >= accept) | (F.col("accuracy") > mend), F.col("step"))
    rows = attempts.groupBy(by).agg(F.coalesce(F.min(able), F.max("step")).alias("step"))
    verdict = F.when(F.col("accuracy") >= accept, "accept").when(F.col("accuracy") > mend, "mend").otherwise("last")
    return rows.join(attempts, [by, "step"]).select(by, "step", "accuracy", verdict.alias("verdict"))


def contents_of_text(docs: DataFrame, make: models.Complete, *, id_col: str, text_col: str = "text", first: int = 100, done: str = "complete") -> DataFrame:
    """``(id, items, asked)``: a table of contents from the first lines of a text, of a window that doubles until the model says ``done`` or the text ends.

    The reply is JSON with ``items`` and ``state``. A text that ends before the model is
    done is continued once with what was found. One document is held at a time.
    """

    def run(batches):
        ask = make()
        for b in batches:
            for key, text in zip(b[0].to_pylist(), b[1].to_pylist()):
                lines, size, asked, items = (text or "").split("\n"), first, 0, []
                while True:
                    reply = json_salvage.loose_json(ask(["\n".join(lines[:size])])[0])
                    reply, asked = reply if isinstance(reply, dict) else {}, asked + 1
                    items = [str(i) for i in reply.get("items") or []]
                    if reply.get("state") == done or size >= len(lines):
                        break
                    size *= 2
                if reply.get("state") != done:
                    more = json_salvage.loose_json(ask(["\n".join(["CONTINUE", *items, *lines])])[0])
                    asked += 1
                    items += [str(i) for i in (more.get("items") or [] if isinstance(more, dict) else []) if str(i) not in items]
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([items], pa.list_(pa.string())), pa.array([asked], pa.int32())], names=["key", "items", "asked"])

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, f"{id_col} string, items array<string>, asked int")


def summaries_of_texts(texts: DataFrame, make: models.Complete, cut: Callable[[Column], Column], *, key: str, text: str = "text", most: int) -> tuple[DataFrame, DataFrame]:
    """``(key, summary)`` and the children ``(key, ord, content, summary)``: a text of up to ``most`` tokens is its own summary; a longer one is cut, its parts are summarised, and their summaries too.

    ``cut`` is an array of a text's parts. A null text is empty.
    """
    counted = texts.select(F.col(key).cast("string").alias(key), F.coalesce(F.col(text), F.lit("")).alias("_x")).withColumn("_n", F.size(F.regexp_extract_all("_x", F.lit(r"\S+"), 0)))
    parts = counted.filter(F.col("_n") > most).select(key, F.posexplode(cut(F.col("_x"))).alias("ord", "content")).withColumn("_k", F.to_json(F.struct(key, "ord")))
    said = extract.complete_all(parts, make, key_col="_k", prompt_col="content").select("_k", F.col("response").alias("summary"))
    children = stored(parts.join(said, "_k").select(key, "ord", "content", "summary"), "children")
    joined = children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda c: c["summary"]), "\n").alias("_p"))
    above = extract.complete_all(joined, make, key_col=key, prompt_col="_p").select(key, F.col("response").alias("_s"))
    return counted.join(above, key, "left").select(key, F.coalesce("_s", strip("_x")).alias("summary")), children


def split_large(sections: DataFrame, parts: Callable[[DataFrame], DataFrame], *, pages: int, tokens: int) -> DataFrame:
    """Sections that span more than ``pages`` pages and hold ``tokens`` tokens or more get the children that ``parts(sections)`` finds in them, and these in turn, until none is large.

    ``sections(doc_id, path, first, last, tokens)``; ``parts`` returns the same columns for
    the children, whose paths extend their section's. A section in which it finds nothing
    stays whole. One pass per depth; each is written, and a child no smaller than its
    section is an error, as it would never end.
    """
    columns = ["doc_id", "path", "first", "last", "tokens"]
    front, out = sections.select(*columns), None
    while True:
        front = stored(front, "sections")
        out = front if out is None else out.unionByName(front)
        large = front.filter((F.col("last") - F.col("first") + 1 > pages) & (F.col("tokens") >= tokens))
        if large.isEmpty():
            return out
        found = stored(parts(large).select(*columns), "parts")
        above = large.select("doc_id", F.col("path").alias("_p"), (F.col("last") - F.col("first")).alias("_span"))
        same = found.join(above, (found["doc_id"] == above["doc_id"]) & (F.regexp_replace("path", r"\.[^.]*$", "") == F.col("_p"))).filter(F.col("last") - F.col("first") >= F.col("_span"))
        if not same.isEmpty():
            raise ValueError("a part is as large as its section")
        front = found


def laid_out(parts: dict[str, tuple[DataFrame, int]], by: str) -> DataFrame:
    """Q2: one ``(by, context, tokens)`` per query from named ``(by, pos, text)`` rows, each part under its own budget and in order; a part without rows is not named.

    Blank texts are left out and count nothing. Of rows of equal ``pos`` the smaller text comes first.
    """
    kept = None
    for n, (name, (rows, budget)) in enumerate(parts.items()):
        said = rows.filter(strip(F.coalesce("text", F.lit(""))) != "").select(by, F.col("pos").cast("long").alias("pos"), "text").withColumn("_t", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)))
        cut = budget_prefix(said, "_t", budget, ["pos", "text"], [by]).select(by, F.lit(n).alias("part"), F.lit(name).alias("name"), "pos", "text", "_t")
        kept = cut if kept is None else kept.unionByName(cut)
    sheets = kept.groupBy(by, "part", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("_body"), F.sum("_t").alias("_t"))
    sheet = F.struct("part", F.concat(F.lit("# "), "name", F.lit("\n"), "_body").alias("s"))
    return sheets.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(sheet)), lambda x: x["s"]), "\n\n").alias("context"), F.sum("_t").alias("tokens"))
