"""The pipeline's stages, each against its operator's own results on its input, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from fernquery.llm import contracts, decontaminate, quality_rules
from fernquery.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, found = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert found.columns == columns
            same = columns if k else [c for c in columns if c != "text"]  # the rules cut lines from texts
            assert found.select(*same).exceptAll(before.select(*same)).count() == 0
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.judge(before).filter("kept").collect()}
            assert {r["doc_id"] for r in found.collect()} == kept
        if name == "decontamination":
            assert decontaminate.contamination(found, table(spark, SF, "benchmark")).filter("n_hit > 0").count() == 0
        docs = found
    assert docs.count() == before.count()
    assert docs.agg({"taken": "sum"}).first()[0] == docs.agg({"size": "sum"}).first()[0]


def test_stages_take_odd_input(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, columns of other names, and an empty table go through all stages."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    own = [(i, words(i, 60 + i), "en", "a") for i in range(8)] + [(None, words(90, 70), None, None), (20, words(3, 63), "en", "b"), (20, words(3, 63), "xx", "b"), (21, None, "en", None), (22, "", "en", "a"), (5, words(99, 80), "en", "a")]
    clash = ("part", "fp", "root", "row", "_gone", "_m_id", "n", "b_id", "c_id", "c_part", "gone", "h_doc", "term", "size", "target", "score", "y", "key")
    frame = spark.createDataFrame([(*r, *["z"] * len(clash)) for r in own], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
    for docs in (frame, frame.limit(0)):
        n = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{n}-{k}"
            stage(spark, docs, SF).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if k < 4:
                assert docs.columns == frame.columns and docs.count() <= before.count()
            if name == "quality_rules":
                assert docs.count() == (12 if n else 0)
            if name == "near_duplicates" and n:
                kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang"]) for r in docs.collect())
                met = {(r["doc_id"], r["text"]) for r in before.collect()}
                assert len(docs.collect()) == len({t for _, t in met}) and all(i != 20 for _, i, _ in kept)


@pytest.mark.parametrize("name", sorted(contracts.ORACLES))
def test_contract_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = contracts.QUERIES[name](spark, SF)
    want = con.sql(contracts.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)
