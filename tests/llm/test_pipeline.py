"""The pipeline's stages on small documents and on the smallest tables."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import empty_documents, odd_documents  # noqa: E402

import corpus_pipeline
from panelspark.llm.common import table


def test_stages_keep_columns_and_rows(spark, sf):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == odd_documents(spark).columns and {r.doc_id for r in docs.collect()} <= before, name
        assert {r.score for r in docs.collect()} <= {9.0}  # a column with a clashing name stays as it was
        if name == "language_id":
            assert before - {r.doc_id for r in docs.collect()} == {0, 1, 2, 4}
        if name == "near_dedup":
            assert not {6, 12, 13} & {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.best_fit(spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_near_dedup_keeps_one_of_each_group(spark, sf):
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    texts = [r.text for r in kept.collect()]
    assert len(set(texts)) == len(texts) == kept.count() < docs.count()
    assert {r.text for r in docs.select("text").distinct().collect()} >= set(texts)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 4096


def test_empty(spark, sf):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
