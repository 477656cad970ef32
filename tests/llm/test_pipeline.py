"""The corpus pipeline as a whole."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
    texts = [r.text for r in at["exact_dedup"].collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts) <= at["toxicity"].count()
    assert 0 < at["toxicity"].count() <= spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert at["minhash_near_dedup"].count() <= len(texts)
    assert at["mixing"].select("doc_id").distinct().join(at["minhash_near_dedup"], "doc_id", "left_anti").count() == 0
    packed = at["packing"]
    ends = packed.where(F.col("start") + F.col("length") == F.col("doc_tokens"))
    assert ends.count() == at["mixing"].count()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed.limit(20).collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(out.columns) and out.count() > 0
