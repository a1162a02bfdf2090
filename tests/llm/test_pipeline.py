"""The pipeline's stages on the small tables."""

from collections import Counter

from pyspark.sql import functions as F

from test_near_copies import classes

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        seen[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pieces":
            assert before.dtypes == docs.dtypes
    assert 0 < seen["quality"].count() < docs.count()
    kept = [r.doc_id for r in seen["near_duplicates"].collect()]
    assert sorted(kept) == sorted(c[0] for c in classes([(r.doc_id, r.text) for r in seen["quality"].collect()]))
    assert seen["secrets"].count() == len(kept)
    assert seen["secrets"].where(F.col("text").rlike("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}")).count() == 0
    assert seen["pieces"].count() == seen["mixing"].count() > 0
    again = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(again) == key(seen["pieces"])


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 30, None, "s", 5), (4, "word " * 30, "en", None, 5), (4, "word " * 30, "en", None, 5), (5, "é" * 100_000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
