"""Edge cases of the flows: nulls, blanks, empty tables, ties and repeated rows."""

import json

import pytest
from pyspark.sql import functions as F

from fernquery.functions import text as X
from fernquery.operators import flows, tree, usage
from fernquery.sources import stores


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def answers(fn):
    return lambda: lambda prompts: [fn(p) for p in prompts]


def test_index_chunks(spark):
    chunks = spark.createDataFrame([("c1", "x"), ("c1", "x"), ("c2", "y"), ("c3", "")], "chunk_id string, content string")
    said = {"x": '("entity"<|>a<|>T<|>d)##("relationship"<|>a<|>b<|>r<|>2)', "y": '("entity"<|>a<|>T<|>d)'}
    nodes, edges = flows.index_chunks(chunks, answers(lambda p: said.get(p, "no")))
    assert rows(nodes.select("node_id", "frequency", F.size("source_ids")), "node_id") == [("A::level::0", 2, 2), ("B::level::0", None, 1)]
    assert rows(edges.select("src", "dst", "weight"), "src") == [("A", "B", 2.0)]
    nodes, edges = flows.index_chunks(chunks.limit(0), answers(lambda p: ""))
    assert nodes.count() == edges.count() == 0


def test_repaired(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source_id string, v int")
    again = spark.createDataFrame([("a", 9), ("a", 8), ("c", 7)], "source_id string, v int")
    want = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "source_id string")
    assert rows(flows.repaired(old, again, want), "source_id", "v") == [("a", 8), ("a", 9), ("b", 2), ("c", 3)]


def test_decompose(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "query_id int, text string")
    said = json.dumps({"entities": ["x", " x ", None, ""], "relations": "a->b; c", "questions": ["why"]})
    got = flows.decompose(asked, answers(lambda p: said if p == "good" else "?"))
    one = got.filter("query_id = '1'").first()
    assert (one["entities"], [tuple(r) for r in one["relations"]], one["questions"]) == (["x"], [("a", "b")], ["why"])
    assert [(r["entities"], r["relations"], r["questions"]) for r in got.filter("query_id <> '1'").collect()] == [([], [], [])] * 2
    assert flows.decompose(asked, answers(lambda p: said), macro=False).filter("size(questions) > 0").isEmpty()


def test_answer_leaves(spark):
    leaves = spark.createDataFrame([("d", 0, "a b"), ("d", 1, " "), ("d", 2, None), ("d", 3, "c"), ("e", 0, None)], "doc string, ord int, text string")
    asked = spark.createDataFrame([("d", "q"), ("d", "q"), ("d", "r"), ("e", "q"), ("f", "q")], "doc string, question string")
    got = flows.answer_leaves(leaves, asked, answers(lambda p: "None" if p.startswith("r") else p.replace("\n", "|")), by="doc", most=1)
    assert rows(got, "doc", "question") == [("d", "q", "q|a b|c"), ("d", "r", None)]
    short = flows.answer_leaves(leaves, asked, answers(lambda p: p.replace("\n", "|")), by="doc", most=2, least=1)
    assert [r["answer"] for r in short.filter("question = 'q'").collect()] == ["q|a b"]


def test_path_relations(spark):
    paths = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["z"]), (3, [])], "k int, path array<string>")
    assert rows(flows.path_relations(paths, ["k"]), "k", "pos") == [(1, "a", "b", 0), (1, "a", "c", 1)]


def test_title_checks(spark):
    items = spark.createDataFrame([("d", 0, "In tro", 1), ("d", 1, "Other", 1), ("d", 2, "Intro", None), ("d", 3, "Intro", 9), ("d", 4, None, 1), ("d", 5, "", 2)], "doc string, ord int, title string, page int")
    pages = spark.createDataFrame([("d", 1, "x INTRO"), ("d", 2, None)], "doc string, page_no int, text string")
    ask = answers(lambda p: " YES " if "Other" in p else "no")
    assert [r["answer"] for r in flows.title_checks(items, pages, ask, by="doc").orderBy("ord").collect()] == ["yes", "yes", "no", "no", "no", "no"]
    assert [r["answer"] for r in flows.title_checks(items, pages, ask, by="doc", starts=True).orderBy("ord").collect()] == ["no", "yes", "no", "no", "no", "no"]


def test_best_attempts(spark):
    tried = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("a", 2, 1.0), ("b", 0, 0.6), ("b", 1, None), ("c", 0, 1.0)], "doc string, step int, accuracy double")
    assert [r[::3] + r[1:2] for r in rows(flows.best_attempts(tried, "doc"), "doc")] == [("a", "mend", 1), ("b", "last", 1), ("c", "accept", 0)]


def test_contents_of_text(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdefgh")), (2, "a"), (3, None)], "doc_id int, text string")

    def say(p):
        if p.startswith("CONTINUE"):
            return '{"items": ["a", "rest"]}'
        return json.dumps({"items": p.split("\n")[:1], "state": "complete" if "d" in p else "open"})

    got = flows.contents_of_text(docs, answers(say), id_col="doc_id", first=2)
    assert rows(got, "doc_id") == [("1", ["a"], 2), ("2", ["a", "rest"], 2), ("3", ["", "a", "rest"], 2)]


def test_summaries_of_texts(spark):
    texts = spark.createDataFrame([(1, " a b "), (2, "a b c d e"), (3, None)], "k int, text string")
    above, below = flows.summaries_of_texts(texts, answers(lambda p: f"<{p}>".replace("\n", "+")), lambda x: F.split(x, " c "), key="k", most=3)
    assert rows(above, "k") == [("1", "a b"), ("2", "<<a b>+<d e>>"), ("3", "")]
    assert rows(below.select("k", "ord", "content"), "ord") == [("2", 0, "a b"), ("2", 1, "d e")]


def test_split_large(spark):
    s = spark.createDataFrame([(1, "1", 1, 9, 90), (2, "1", 1, 9, 5)], "doc_id int, path string, first int, last int, tokens int")
    once = lambda large: large.filter("path = '1'").select("doc_id", F.lit("1.1").alias("path"), "first", F.lit(8).alias("last"), F.lit(50).alias("tokens"))
    assert rows(flows.split_large(s, once, pages=3, tokens=10).select("doc_id", "path"), "doc_id", "path") == [(1, "1"), (1, "1.1"), (2, "1")]
    with pytest.raises(ValueError):
        flows.split_large(s, lambda large: large.withColumn("path", F.concat("path", F.lit(".1"))), pages=3, tokens=10)


def test_laid_out(spark):
    a = spark.createDataFrame([(1, 0, "x y"), (1, 0, "a"), (1, 1, " "), (1, 2, None), (1, 3, "over the budget"), (2, 0, "")], "q int, pos int, text string")
    b = spark.createDataFrame([(1, 5, "last"), (3, 1, "only")], "q int, pos int, text string")
    assert rows(flows.laid_out({"one": (a, 4), "two": (b, 4)}, "q"), "q") == [(1, "# one\na\nx y\n\n# two\nlast", 4), (3, "# two\nonly", 1)]


def test_nested(spark):
    flat = spark.createDataFrame([("d", [1], "1", "A", "", None), ("d", [1, 2], "x", "B", "s", ""), ("d", [1, 2, 1, 1], "y", "C", "", "t"), ("d", [10], "10", "E", "", ""), ("d", [2], "2", "D", "", "")], "doc_id string, path_array array<int>, node_id string, title string, summary string, text string")
    got = json.loads(tree.nested(flat).first()["content"])["structure"]
    assert [x["title"] for x in got] == ["A", "D", "E"]
    assert got[0]["nodes"] == [{"title": "B", "node_id": "x", "summary": "s", "nodes": [{"title": "C", "node_id": "y", "text": "t"}]}]
    assert tree.nested(flat.limit(0)).isEmpty()


def test_report_and_spans(spark):
    calls = spark.createDataFrame([], "stage string, model string, source string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert [r["line"] for r in usage.report(usage.rollup(calls)).collect()] == ["No usage."]
    pages = spark.createDataFrame([("d", 2, None), ("d", 1, "a"), ("e", 5, "z")], "doc string, page_no int, text string")
    assert rows(stores.page_span_text(pages, 1, 3), "doc") == [("d", "a", 2), ("e", "", 1)]


def test_lists_and_tags(spark):
    frame = spark.createDataFrame([(0, "a<SEP> b <SEP>"), (1, '["a<SEP>b"]'), (2, None)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(X.section_list(F.col("t"), "<SEP>")).collect()] == [["a", "b"], ["a<SEP>b"], []]
    tagged = "pre<physical_index_1>\none\n<physical_index_1><physical_index_2>two<physical_index_2>"
    frame = spark.createDataFrame([(0, tagged), (1, "<physical_index_3> alone"), (2, ""), (3, None)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(X.without_first_page(F.col("t"))).collect()] == ["pre<physical_index_2>two<physical_index_2>", "<physical_index_3> alone", "", None]
