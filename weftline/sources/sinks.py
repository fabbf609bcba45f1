"""Sinks: overwriting JSON, one folder for each entity with a summary, one text, upsert and reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Replaces what is at ``path``; the commit protocol makes a second run safe."""
    df.write.mode("overwrite").json(path)


def write_by_entity(df: DataFrame, path: str, entity: str = "entity") -> None:
    """One folder for each entity, and ``summary`` with their counts."""
    kept = df.where(F.col(entity).isNotNull())
    kept.write.mode("overwrite").partitionBy(entity).json(f"{path}/entities")
    kept.groupBy(entity).count().write.mode("overwrite").json(f"{path}/summary")


def write_by_file(routes: DataFrame, path: str, file: str = "file") -> None:
    """All routes in one table, and beside it one row for each file with its routes in order."""
    write_json(routes, f"{path}/routes")
    rest = [c for c in routes.columns if c != file]
    write_json(routes.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("ord",) if c in rest], *[c for c in rest if c != "ord"]))).alias("routes")), f"{path}/routes-by-file")


def write_results(path: str, routes: DataFrame, relationships: DataFrame, enriched: DataFrame, document: DataFrame) -> None:
    """The outputs of a run: routes (all, and by file), relationships, enriched routes, and the OpenAPI document; each replaces what was there."""
    write_by_file(routes, path)
    write_json(relationships, f"{path}/relationships")
    write_json(enriched, f"{path}/enriched")
    write_text(document, "document", f"{path}/openapi")


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A report of one row as a text file."""
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> None:
    """Rows of ``new`` replace those of their key in the Parquet table at ``path``, written as a new version beside the old one."""
    try:
        old = spark.read.parquet(f"{path}/*").select(*new.columns, "_version")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    version = 0 if old is None else (old.agg(F.max("_version")).first()[0] or 0) + 1
    new.withColumn("_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/v{version}")


def current(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The latest row of each key of an upserted table."""
    df = spark.read.parquet(f"{path}/*")
    rest = [c for c in df.columns if c not in key and c != "_version"]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "_version").alias("r")).select(*key, "r.*")


def reset(spark: SparkSession, path: str, force: bool = False) -> bool:
    """Deletes what is at ``path`` if ``force``; tells whether it did."""
    if not force:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
