"""The pipeline's stages take effect, and run() is their composition."""

from collections import Counter

import corpus_pipeline
from cognatus.llm import mixing, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 456", "en", None, 7), (9003, "ok text", None, "src1", None)], docs.schema)
    docs = docs.unionByName(extra)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.materialize(stage(spark, kept[-1], SMALL)))
        assert kept[-1].columns == COLUMNS
    ids = [Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]
    assert set(ids[0]) - set(ids[1]) == {9001, 9002}
    assert set(ids[2]) < set(ids[1]) and max(ids[2].values()) == 1
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) == 2
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(kept[2].withColumn("size", mixing.word_count("text"))).collect()}
    assert ids[3] == Counter({k: v for k, v in taken.items() if v})
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[3], SMALL)
    starts = Counter(r["doc_id"] for r in pieces.where("start = 0").collect())
    assert starts == ids[3]


def test_run(spark):
    one = corpus_pipeline.run(spark, SMALL)
    total = one.groupBy("doc_id").sum("length").count()
    assert total > 100
    assert "pipeline" in queries.queries() and corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
