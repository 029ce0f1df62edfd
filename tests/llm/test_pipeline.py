"""The pipeline: each stage on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tracewright.llm import minhash, mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("keep", ["true", "false"], ids=["all", "empty"])
def test_stages(spark, tmp_path, keep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(keep)
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        results.append((before, docs))
        assert name == "sentencepiece" or docs.columns == columns

    def ids(df):
        return Counter(r["doc_id"] for r in df.select("doc_id").collect())

    (a, good), (_, single), (_, private), (_, mixed), (_, encoded) = results
    assert ids(good) == ids(quality.judge(a).where("kept"))
    assert ids(single) == ids(minhash.classes(good).where("is_kept"))
    assert ids(private) == ids(single)
    want = mixing.plan_mix(private).where("copies > 0").collect()
    assert ids(mixed) == Counter({r["doc_id"]: r["copies"] for r in want})
    assert ids(encoded) == ids(mixed) and encoded.where(~F.col("aligned")).isEmpty()
