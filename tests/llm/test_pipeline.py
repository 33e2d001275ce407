"""The pipeline's stages: columns, kept rows, and packing of all that is left."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    ids = spark.read.parquet(str(tmp_path / "suffix_array_dedup")).select("doc_id").distinct()
    assert docs.select("doc_id").distinct().exceptAll(ids).isEmpty() and ids.count() == counts[3]


def test_run_on_odd_rows(spark, tmp_path):
    good = "Plain words make a calm and quiet sentence for all of us. " * 3
    rows = [(1, good + "One.", "en", "s", 9), (2, good + "One.", "en", "s", 9), (2, None, None, None, None), (None, good + " Two more words end it.", "en", "s", 1), (3, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert 2 not in {r.doc_id for r in got} and 3 not in {r.doc_id for r in got}
