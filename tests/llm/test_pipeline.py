"""The pipeline, stage by stage, against plain versions on its own inputs."""

import corpus_pipeline
from maskwright.llm import common
from tests.llm import plain


def test_stages(spark, small, edges, tokenizer):
    docs = common.table(spark, small, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_passages", "decontaminated", "packed"]
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, small), name)
        if name == "near_duplicates":
            want = {c for _, c in plain.near_classes([(r.doc_id, r.text) for r in docs.collect()]).values()}
            assert {r.doc_id for r in out.collect()} == want
        if name == "repeated_passages":
            assert not [k for k in plain.repeats([(r.doc_id, r.text) for r in out.collect()], 50) if not k[1]]
        if name == "packed":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
        else:
            assert out.columns == columns
            docs = out


def test_an_empty_table(spark, small, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), name)
        assert docs.count() == 0
