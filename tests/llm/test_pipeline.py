"""The pipeline stage by stage on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= before
        if name != "encode":
            assert out.columns == columns
        docs, before = out, out.count()
    assert before > 100 and docs.where("n_tokens <> size(ids)").count() == 0
