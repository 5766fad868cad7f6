"""The pipeline's stages on real rows, each against what it may drop."""

import re

import corpus_pipeline
from pathlift.llm import queries


def test_stages_keep_what_they_should(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert all(before[i] == r for i, r in after.items()), name
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0D]+", " ", before[i].text), i)
            assert set(after) == set(first.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = pieces.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r.doc_id for r in rows} == set(before) and all(r["sum(length)"] == r.doc_tokens for r in rows)


def test_names_agree():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE) <= set(queries.QUERIES)
