"""The stages over the small tables, each against what its operator says of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from weftline.llm import language, mixing, pieces, quality_model, simhash
from weftline.llm.common import remainder, words, written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "language ID", "near-dedup", "mixing", "encoding"]

    kept = written(stages["quality classifier"](spark, docs, sf_dir), "t")
    want = quality_model.classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())

    told = written(stages["language ID"](spark, kept, sf_dir), "t")
    model = language.fit_languages(kept.where(remainder("doc_id", 4) != 2).select("text", "lang"))
    want = language.identify(kept.select("doc_id", "text"), model).where("lang_pred <> 'und' and score >= 0.25")
    assert told.columns == columns and sorted(r.doc_id for r in told.collect()) == sorted(r.doc_id for r in want.collect())
    assert told.count() > 0.98 * kept.count()

    single = written(stages["near-dedup"](spark, told, sf_dir), "t")
    want = {r.component_id for r in simhash.near_dedup(told).collect()}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)

    mixed = written(stages["mixing"](spark, single, sf_dir), "t")
    want = {r.doc_id: r.taken for r in mixing.mix_sources(single).where("taken > 0").collect()}
    assert mixed.columns == columns
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.size(words("text"))).alias("n")).collect()} == want

    ids = stages["encoding"](spark, mixed, sf_dir)
    back = pieces.decode_documents(ids)
    assert ids.where("not lossless").count() == 0
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect())


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_ids", "n_bytes", "lossless", "ids"] and out.count() > 0
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "t")
    assert docs.count() == 0
