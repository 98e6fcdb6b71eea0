import corpus_pipeline


def test_stages_keep_the_columns_and_drop_rows_only(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= ids
    assert len(out) == len({r.doc_id for r in out}) > 0
