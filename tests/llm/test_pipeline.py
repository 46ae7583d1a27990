"""The stages in turn against what each should do, on the smallest data."""

import corpus_pipeline
from clauselens.llm import catalogue, tiling
from clauselens.llm.common import materialise, table
from clauselens.llm.contextual_pii import private_data
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    frames = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = materialise(stage(spark, before, SF), "test")
        assert before.columns == columns
        frames[name] = before
    ids = {n: {r[0] for r in f.select("doc_id").collect()} for n, f in frames.items()}
    judged = catalogue.QUERIES["op2_quality_rules"](spark, SF)
    assert ids["quality"] == {r[0] for r in judged.filter("kept").select("doc_id").collect()}
    assert ids["quality"] >= ids["near_duplicates"] >= ids["decontamination"] == ids["private_data"]
    texts = [r[0] for r in frames["near_duplicates"].select("text").collect()]
    assert len(texts) == len(set(texts))
    assert tiling.contaminated(frames["decontamination"], table(spark, SF, "benchmark")).count() == 0
    left = private_data(frames["private_data"]).filter("n_email + n_ip + n_card + n_phone > 0")
    assert left.count() == 0
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == ids["private_data"]
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_queries_against_sql(spark):
    con = connect(SF)
    for name, fn in catalogue.QUERIES.items():
        assert compare(spark, con, name, fn, catalogue.ORACLES.get(name), SF) is None, name
