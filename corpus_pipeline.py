"""A corpus pipeline of five stages; each works on all that its predecessor kept and is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, mixing, pieces, quality_model, simhash
from weftline.llm.common import discard, remainder, table, written

#: Learned models and connected components can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier by co-training; documents that it rejects go."""
    model = quality_model.fit_quality(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")), table(spark, sf_dir, "labels"))
    return quality_model.keep_quality(docs, model)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification, learned from the documents whose crc32 modulo 4 isn't 2; documents without a sure language go."""
    return language.keep_languages(docs, language.fit_languages(docs.where(remainder("doc_id", 4) != 2).select("text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup; one document of each component stays."""
    return simhash.keep_one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights; documents are repeated, cut or left out as the mix takes their words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding with merge-dropout, decoded again as proof: doc_id, n_ids, n_bytes, lossless, ids."""
    return pieces.encode_documents(docs)


STAGES = [("quality classifier", quality), ("language ID", languages), ("near-dedup", near_dedup), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            discard(before)
    return docs
