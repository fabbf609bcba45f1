"""Resumable enrichment: only rows whose key isn't done yet are worked on, in a batch or as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import pending


def done_keys(spark: SparkSession, path: str, key: list[str], like: DataFrame) -> DataFrame:
    """The keys written so far; none if nothing is."""
    try:
        return spark.read.parquet(path).select(*key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.select(*key).limit(0)


def run_pending(work: DataFrame, path: str, key: list[str], enrich: Callable[[DataFrame], DataFrame]) -> int:
    """Enriches and appends what isn't at ``path`` yet, one row for each key; the number of rows written. A run that is cut off leaves whole files or none."""
    spark = work.sparkSession
    todo = pending(work.dropDuplicates(key), done_keys(spark, path, key, work), key)
    written = Observation()
    enrich(todo).observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return written.get["rows"]


def stream_pending(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, key: list[str], enrich: Callable[[DataFrame], DataFrame]):
    """The same over a growing folder of Parquet files. Each micro-batch goes to a folder of its own number and leaves out the keys of the batches before it, never
    its own, so a batch that is repeated after a failure replaces itself by the same rows. ``path`` and ``checkpoint`` belong together."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.dropDuplicates(key)
        for earlier in done_before(spark, path, number):
            fresh = pending(fresh, earlier.select(*key), key)
        enrich(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def done_before(spark: SparkSession, path: str, number: int) -> list[DataFrame]:
    """What the batches below ``number`` have written: one table, or none if nothing is."""
    try:
        return [spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") < number)]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def progress_of(done: DataFrame, total: int) -> DataFrame:
    return done.agg(F.count("*").alias("processed")).withColumn("total", F.lit(total))
