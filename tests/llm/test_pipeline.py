"""The pipeline on the smallest table, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as entry


def test_every_operator_has_one_query():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages_keep_the_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small).cache()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert out.count() >= 0.98 * docs.count()
        if k in (1, 2):
            assert out.count() <= docs.count()
        docs = out
    assert docs.count() > 100 and docs.filter("n_tokens < 0 or size(ids) != n_tokens").count() == 0
    assert corpus_pipeline.run(spark, small).count() == docs.count()
