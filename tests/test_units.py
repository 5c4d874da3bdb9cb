"""Hand-computed cases of operators, edge cases first."""

import json

import pytest
from pyspark.sql import functions as F

from fernquery.functions import json_salvage
from fernquery.functions import text as X
from fernquery.operators import chunk, evidence, extract, graph, index, linking, models, ranking, toc, tree
from fernquery.plans import boundary, trees
from fernquery.sources import stores


def values(spark, texts, fn):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in frame.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalise_field(spark):
    got = values(spark, ['"a"', "\"'b'\"", ' "c" ', 'd"', '"e', "it's", '""f""', '"""g"""', "h\ni", '"', "", None], X.normalise_field)
    assert got == ["a", "b", "c", "d", "e", "it's", "f", '"g"', "hi", "", "", None]


def test_clean_and_entities(spark):
    assert values(spark, [" a&amp;b\u0007\u0085 ", None], lambda x: X.clean(x, entities=True)) == ["a&b", None]


def test_html_unescape_equals_its_sql_on_entities_cut_short(spark, tmp_path):
    import duckdb

    from fernquery.plans import registry

    texts = ["<title>a &amp; b &amp</title>", "&am &a & &", "&ampx; &quot &lt&gt; &copy2 &copy;2", "&amp;lt; &amp;amp; &amp;#39;", "&nbsp;&eacute;&#38;&#39;&#039;&#x27;", " \n&middot;\t ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = dict(map(tuple, registry.queries()["html_unescape"](spark, str(tmp_path)).select("page_id", "clean_md5").collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.sql(registry.oracle_sql()["html_unescape"]).project("page_id, clean_md5").fetchall())
    assert values(spark, ["&amp &eacute; &amp;"], X.clean) == ["& é &"]


def test_relation_ends(spark):
    got = values(spark, ["a -> b", "a-b->c", "x => y", "p→q", "none", "k-l"], X.relation_ends)
    assert [tuple(g) if g else None for g in got] == [("a", "b"), ("a-b", "c"), ("x", "y"), ("p", "q"), None, ("k", "l")]


def test_numbers_and_pages(spark):
    assert values(spark, ["1", "-2.5", ".5", "1.", "1e3", "x", None], X.is_number) == [True, True, True, False, False, False, False]
    assert values(spark, ["<physical_index_12>", "7", "x", None], X.page_tag) == [12, 7, None, None]
    assert values(spark, ["a::level::2", "a::level::b::level::3", "a"], X.level_of) == [2, 3, None]
    assert values(spark, ["a::level::2", "a::level::b::level::3", "a"], X.name_of) == ["a", "a::level::b", "a"]
    assert values(spark, ['["a", " b "]', "plain", "", None], X.section_list) == [["a", "b"], ["plain"], [], []]
    assert values(spark, ["12", 'a "b"', "'c'"], X.enclosed) == ["12", '"a "b"', "\"'c'\""]
    assert values(spark, ["Intro.......... 5", "A. . . . . . 3"], X.dot_leaders) == ["Intro:  5", "A: 3"]
    assert values(spark, ["12. Title here\nmore", "—"], X.chunk_title) == ["Title here", "Section Chunk"]
    assert values(spark, ["  ", None, "—\nmore", "9. É x"], X.chunk_title) == ["Section Chunk", "Section Chunk", "Section Chunk", "É x"]


def test_json_salvage():
    assert json_salvage.reply_object('say {"a": {"b": 1}} end') == {"a": {"b": 1}}
    assert json_salvage.reply_object('{"a": [1, 2,], "b": true') == {"a": "1", "b": True}
    assert json_salvage.first_object('{"a": 1,} {"b": 2}') is None
    assert json_salvage.loose_json('```json\n{"a": None,}\n```') == {"a": None}
    assert json_salvage.toc_items({"toc": [{"title": "x"}, 3]}) == [{"title": "x"}]
    assert json_salvage.loose_json(None) == {}


def test_token_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ord"], r["tokens"], r["content"]) for r in chunk.token_windows(docs, 5, 2).collect())
    assert got == [(1, 0, 5, "0 1 2 3 4"), (1, 1, 5, "3 4 5 6 7"), (1, 2, 4, "6 7 8 9"), (1, 3, 1, "9"), (4, 0, 1, "one")]
    leaf = docs.select("doc_id", F.lit("s").alias("section_id"), F.lit("1").alias("path"), "text")
    assert chunk.leaf_windows(leaf, 10, 2).filter("doc_id = 1").count() == 1


def test_packing(spark):
    docs = spark.createDataFrame([(1, "a b c. d e f. " * 3), (2, None), (3, "x " * 25)], "doc_id long, text string")
    sep = {r["doc_id"]: [c["tokens"] for c in r["c"]] for r in docs.select("doc_id", chunk.separator_chunks(F.col("text"), 10).alias("c")).collect()}
    assert sep[1] == [9, 9] and sep[2] == [] and sep[3] == [10, 10, 5]
    whole = docs.select("doc_id", F.array_join(F.transform(chunk.separator_chunks(F.col("text"), 4), lambda c: c["piece"]), "").alias("t"), "text").filter("text is not null").collect()
    assert all(r["t"] == r["text"] for r in whole)
    over = docs.filter("doc_id = 3").select(chunk.separator_chunks(F.col("text"), 10, 3).alias("c")).first()["c"]
    assert all(c["tokens"] <= 10 for c in over)


def test_budget(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 90), (4, 1)], "i int, n int")
    assert [r["i"] for r in ranking.budget_prefix(rows, "n", 10, ["i"]).orderBy("i").collect()] == [1, 2]
    assert ranking.budget_prefix(rows, "n", 0, ["i"]).count() == 0
    assert ranking.sample_rows(rows, None, 1).count() == 4 and ranking.sample_rows(rows, 2, 1).count() == 2


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "Cat dog"), (2, "cat cat 猫"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "???"), (3, "猫 fish")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]) for r in index.bm25(docs, asked).collect()}
    assert got == {(1, 1), (1, 2), (3, 2)}
    assert index.weights(0, 0) == (0.7, 0.3) and index.weights(1, 1) == (0.5, 0.5)


def test_normalised_scores(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 3.0)], "q int, s double")
    got = sorted((r["q"], r["n"]) for r in rows.withColumn("n", index.normalised("s", ["q"])).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 1.0), (2, 1.0)]


def test_records(spark):
    reply = '("entity"<|>Ann<|>person|>tall)##("entity"<|>Bob<|>short)##("relationship"<|>ann<|>bob<|>knows<|>2.5)##("entity"<|>Broken<|>x\n<|>y##("relationship"<|>a<|>b<|>c<|>"3")<|COMPLETE|>'
    rows = extract.records(spark.createDataFrame([("c", reply), ("d", None)], "source_id string, response string"))
    assert sorted((r["entity_name"], r["entity_type"], r["description"]) for r in extract.entities(rows).collect()) == [("ANN", "person", "tall"), ("BOB", "unknown", "short")]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in extract.relations(rows).collect()) == [("A", "B", 1.0), ("ANN", "BOB", 2.5)]


def test_gleaning(spark):
    make = lambda: lambda prompts: ["yes" if p.endswith("more?") else f"[{len(p)}]" for p in prompts]
    got = extract.glean_all(spark.createDataFrame([("a", "p")], "source_id string, prompt string"), make, 2, "go on", "more?").first()
    assert got["response"].count("[") == 3
    none = lambda: lambda prompts: ["no" if p.endswith("more?") else f"[{len(p)}]" for p in prompts]
    got = extract.glean_all(spark.createDataFrame([("a", "p")], "source_id string, prompt string"), none, 2, "go on", "more?").first()
    assert got["response"].count("[") == 1  # it is asked before the first continuation


def test_fields_are_unescaped(spark):
    reply = '("entity"<|>AT&amp;T<|>org<|>a &quot;firm&quot;)##("entity"<|>AT&T<|>org<|>x &amp;amp; y)'
    got = extract.entities(extract.records(spark.createDataFrame([("c", reply)], "source_id string, response string"))).orderBy("ord").collect()
    assert [(r["entity_name"], r["description"]) for r in got] == [("AT&T", 'a "firm'), ("AT&T", "x & y")]


def test_reply_with_a_closing_bracket_alone_has_failed(spark):
    frame = spark.createDataFrame([("a <|> b)",), ("a <|> b",), ("plain",)], "r string")
    assert [x[0] for x in frame.select(extract.parse_failed(F.col("r"), F.lit(0))).collect()] == [True, False, False]


def test_relation_pairs(spark):
    got = values(spark, ["a → b => c\nx->y； -> z;k-l", None, "=>"], X.relation_pairs)
    assert [[tuple(p) for p in r] for r in got] == [[("a", "b => c"), ("x", "y"), ("k", "l")], [], []]


def test_types_and_descriptions_have_their_own_placeholders(spark):
    nodes = spark.createDataFrame([("a", ["org"], ["na"], ["chunk-1"]), ("b", ["unk"], ["told"], ["chunk-2"]), ("c", ["org"], ["N/A"], ["chunk-3"])], "node_id string, entity_types array<string>, descriptions array<string>, source_ids array<string>")
    edges = spark.createDataFrame([], "src_node_id string, dst_node_id string, source_ids array<string>")
    assert sorted(r["source_id"] for r in graph.integrity(nodes, edges).collect()) == ["chunk-2", "chunk-3"]


def test_paragraphs(spark):
    long = " ".join(f"w{i}" for i in range(400))
    text = f"  one two\n \nthree\n\n{long}\n\nlast words "
    got = [(c["piece"], c["tokens"]) for c in values(spark, [text], lambda x: chunk.paragraph_chunks(x, 100))[0]]
    assert got[0] == ("one two\n\nthree", 3) and got[-1] == ("last words", 2)
    assert all(p == p.strip() for p, _ in got) and "".join(p.replace(" ", "") for p, _ in got[1:-1]) == long.replace(" ", "")


@pytest.fixture(scope="module")
def line(spark):
    facts = spark.createDataFrame([("s", i, a, b, 1.0, "d", 0) for i, (a, b) in enumerate([("A", "B"), ("B", "C"), ("C", "D"), ("A", "E"), ("E", "D"), ("X", "Y"), ("Z", "Z")])], "source_id string, ord int, src string, dst string, weight double, description string, level int")
    return facts


def test_edges_are_idempotent(line):
    once, twice = graph.merge_edges(line), graph.merge_edges(line.unionByName(line))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_degrees_and_paths(spark, line):
    edges = graph.merge_edges(line)
    assert {r["node_id"]: r["degree"] for r in graph.degrees(edges).collect()}["Z::level::0"] == 2
    pairs = spark.createDataFrame([("A", "D"), ("A", "A"), ("A", "X"), ("B", "E")], "head string, tail string").select(*[F.concat(c, F.lit("::level::0")).alias(c) for c in ("head", "tail")])
    got = {(r["head"][0], r["tail"][0]): [n[0] for n in r["path"]] for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("A", "D"): ["A", "E", "D"], ("A", "A"): ["A"], ("B", "E"): ["B", "A", "E"]}
    walk = [r["node_id"][0] for r in graph.chained_path(edges, ["B::level::0", "A::level::0", "X::level::0"]).orderBy("leg", "p").collect()]
    assert walk == ["B", "A", "X"]
    roots = {r["node_id"][0]: r["root"][0] for r in graph.connected_components(edges).collect()}
    assert roots == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "A", "X": "X", "Y": "X", "Z": "Z"}


def test_neighbour_chunks_of_a_hub_are_not_multiplied(spark):
    """A hub with 200 chunks and 200 neighbours: no step makes a row for each chunk and neighbour."""
    n = 200
    nodes = spark.createDataFrame([("hub", [f"c{i}" for i in range(n)]), *[(f"n{i}", [f"c{i // 2}", f"own{i}"]) for i in range(n)]], "node_id string, source_ids array<string>")
    edges = spark.createDataFrame([("hub", f"n{i}") if i % 2 else (f"n{i}", "hub") for i in range(n)] + [("n1", "hub"), ("n1", "n2")], "src_node_id string, dst_node_id string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = graph.neighbour_chunks(nodes, edges, spark.createDataFrame([("hub",)], "node_id string"))
        got = sorted(map(tuple, found.collect()))
        made, plans = [], [found._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if (metric := plan.metrics().get("numOutputRows")).isDefined():
                made.append(metric.get().value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == sorted(("hub", f"c{i}", 2 if i < n // 2 else 0) for i in range(n))
    assert 0 < max(made) <= 5 * n


def test_evidence_merge_ignores_placeholders(spark):
    rows = spark.createDataFrame([("n", 2, "keyword", 5, "told", ""), ("n", 1, "vector", 3, "unknown", "c1"), ("n", 3, "vector", 1, "late", "c2")], "node_id string, pos int, tag string, rank int, description string, source_id string")
    assert tuple(evidence.merge_evidence(rows, ["node_id"]).first()) == ("n", 5, "told", "c1", "vector+keyword", 1)


def test_tree(spark):
    doc = '{"doc_name": "x", "structure": [{"title": " A ", "nodes": [{"title": "B", "children": [{"title": "C", "text": "t", "node_id": "c9"}, 7]}]}, "stray", {"title": "D", "text": "d", "nodes": []}]}'
    docs = spark.createDataFrame([(1, doc), (2, "no json"), (3, '{"structure": []}'), (4, None)], "doc_id long, content string")
    found = tree.flatten(docs)
    got = sorted((r["path"], r["title"], r["node_id"], r["depth"], r["n_children"]) for r in found.collect())
    assert got == [("1", "A", "1", 1, 1), ("1.1", "B", "1.1", 2, 1), ("1.1.1", "C", "c9", 3, 0), ("3", "D", "3", 1, 0)]
    assert {r["path"]: r["level"] for r in tree.levels(found).collect()} == {"1": 3, "1.1": 2, "1.1.1": 1, "3": 1}
    assert [r["number"] for r in tree.preorder_ids(found).orderBy("path_array").collect()] == ["0000", "0001", "0002", "0003"]


def test_toc(spark):
    pairs = spark.createDataFrame([(1, i, p, p + o) for i, (p, o) in enumerate([(1, 3), (2, 1), (3, 3), (4, 1)])], "d int, ord int, page int, physical int")
    assert tuple(toc.page_offset(pairs, "d").first()) == (1, 3, 2)
    assert toc.page_range("3-9", 7) == [3, 4, 5, 6, 7] and toc.page_range("2:2", 9) == [2]
    for bad in ("x", "4-2", "5"):
        with pytest.raises(ValueError):
            toc.page_range(bad, 9)
    items = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 2, 1, 2, 3, 1])], "doc_id int, ord int, level int")
    assert [r["structure"] for r in toc.outline_numbers(items).orderBy("ord").collect()] == ["1", "1.1", "1.2", "2", "2.1", "2.1.1", "3"]
    deep = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 8, 8, None, 2])], "doc_id int, ord int, level int")
    assert [r["structure"] for r in toc.outline_numbers(deep).orderBy("ord").collect()] == ["1", "1.0.0.0.0.0.0.1", "1.0.0.0.0.0.0.2", None, "1.1"]
    candidates = spark.createDataFrame([("d", 0, "a", [5, 2], [False, True]), ("d", 1, "b", [1, 4], [True, False]), ("d", 2, "c", [3], [True])], "doc string, ord int, title string, lines array<int>, verified array<boolean>")
    assert [r["line_no"] for r in toc.assign_in_order(candidates, "doc").orderBy("ord").collect()] == [2, 4, None]
    pages = spark.createDataFrame([(1, i, 60) for i in range(1, 7)], "doc_id int, page_no int, tokens int")
    groups = {}
    for r in toc.page_groups(pages, 130).collect():
        groups.setdefault(r["group_no"], []).append(r["page_no"])
    uneven = spark.createDataFrame([(2, i, n) for i, n in enumerate([276, 1, 275, 275, 174])], "doc_id int, page_no int, tokens int")  # 1001 in all: 276 to a group
    assert sorted((r["group_no"], r["page_no"]) for r in toc.page_groups(uneven, 300, overlap=0).collect()) == [(0, 0), (1, 1), (1, 2), (2, 3), (3, 4)]
    assert all(groups.values()) and {p for g in groups.values() for p in g} == set(range(1, 7))


def test_settings():
    q = models.QuerySettings(entity_k=3, tree_traversal="no")
    assert models.resolved("entity_k", q, {"entity_k": 7}) == 3
    assert models.resolved("relation_k", q, {"relation_k": "8"}) == 8
    assert models.resolved("keyword_k", q, {"keyword_k": -1}) == 10
    assert models.resolved("tree_traversal", q, {"tree_traversal": True}) is False
    with pytest.raises(ValueError):
        stores.configured(models.QuerySettings, {"nothing": 1})


def test_stores(spark, tmp_path):
    (tmp_path / "kv.json").write_text('{"a": "x", "b": " "}')
    assert [tuple(r) for r in stores.text_store(spark, f"file://{tmp_path}/kv.json").collect()] == [("a", "x")]
    (tmp_path / "doc.txt").write_text("  hello\nthere ")
    assert stores.texts(spark, f"file://{tmp_path}/doc.txt").first()["content"] == "hello\nthere"
    assert stores.documents_from(spark, ["x", " x "]).count() == 1
    log = f"file://{tmp_path}/log"
    for _ in range(2):
        stores.append_log(spark.range(1), log)
    assert spark.read.json(log).count() == 2
    stores.drop(spark, log)
    assert not (tmp_path / "log").exists()
    old, new = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int"), spark.createDataFrame([("a", 9, None), ("c", 5, 6)], "k string, x int, y int")
    assert sorted(map(tuple, graph.upsert(old, new, "k").collect())) == [("a", 9, 2), ("b", 3, 4), ("c", 5, 6)]
    assert sorted(map(tuple, graph.replace_rows(old, new, "k").collect()), key=repr) == [("a", 9, None), ("b", 3, 4), ("c", 5, 6)]


@pytest.fixture(scope="module")
def whole_documents(spark, tmp_path_factory):
    """Documents that differ from cut ones only far behind their beginning."""
    path = tmp_path_factory.mktemp("sf")
    tail = 'a "quoted" {word}\tand\u0001 more\n'
    rows = [(i, "word " * 20 + tail * 3 + f"end {i}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), dict(rows)


def test_json_salvage_reads_whole_documents(spark, whole_documents):
    path, texts = whole_documents
    got = {r["doc_id"]: json.loads(r["loose"]) for r in boundary.json_salvage_query(spark, path).collect()}
    assert {i: got[i]["answer"] for i in got if i % 3 != 1} == {i: t for i, t in texts.items() if i % 3 != 1}
    assert len(got) == len(texts)


def test_titles_come_from_all_lines(spark, whole_documents):
    path, texts = whole_documents
    got = {(r["doc"], r["title"]) for r in trees.title_assignment(spark, path).select(F.col("doc").cast("long"), "title").collect()}
    assert got == {(i, line) for i, t in texts.items() for line in t.split("\n")}


def test_next_titles(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["Intro", "", "one", "Methods used", "Intro", "end"])], "doc_id string, line_no int, line string")
    titles = spark.createDataFrame([("d", 0, "intro"), ("d", 1, " meth ods"), ("d", 2, "none"), ("d", 3, "INTRO 2"), ("e", 0, "x")], "doc_id string, ord int, title string")
    got = linking.next_titles(titles, lines, "doc_id").orderBy("doc_id", "ord").collect()
    assert [r["line_no"] for r in got] == [0, 3, None, 4, None]


def test_reshaped_trees(spark):
    text = '{"a": 1, "text": "x", "nodes": [{"title": "t", "text": "y", "id": 2}]}'
    got = values(spark, [text, "no json", None], lambda x: tree.reshaped(x, remove=("text",), order=("nodes", "id")))
    assert got == ['{"nodes": [{"id": 2, "title": "t"}], "a": 1}', "no json", None]


def test_sparsity_of_a_single_member(spark):
    frame = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (2, 2)], "layer int, cluster int")
    got = linking.sparsity(frame).orderBy("layer").collect()
    assert got[0]["sparsity"] is None and abs(got[1]["sparsity"] - (1 - 2 / 6)) < 1e-12
