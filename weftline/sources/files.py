"""Source files: a tree walk with pruning, whole-file reads, and JSON documents in several shapes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRUNED = ("node_modules",)


def walk(root: str, suffixes: tuple[str, ...] = (".js",), pruned: tuple[str, ...] = PRUNED) -> list[str]:
    """Files below ``root``, depth first, by name; folders that are pruned or start with a dot are skipped. A file is its own tree; anything else none.

    This lists a mounted tree on the driver: names only, and the rule differs from Spark's, which hides names that start with an underscore.
    """
    if os.path.isfile(root):
        return [root] if root.endswith(suffixes) else []
    found: list[str] = []
    for folder, folders, names in os.walk(root, onerror=lambda e: None):
        folders[:] = sorted(f for f in folders if f not in pruned and not f.startswith("."))
        found += [os.path.join(folder, n) for n in sorted(names) if n.endswith(suffixes)]
    return found


def read_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".js",), pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """file and src of a mounted tree. Executors open the files; one that can't be read has a null text."""
    paths = walk(root, suffixes, pruned)
    listed = spark.createDataFrame([(p,) for p in paths], "file string")
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column("file").to_pylist():
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        text = f.read()
                except OSError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], ["file", "src"])

    return listed.repartition(tasks).mapInArrow(run, "file string, src string")


def scan_sources(spark: SparkSession, *paths: str, glob: str = "*.js", pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """The same through Spark's own reader, for stores that only Spark reads: files named by ``glob`` at any depth."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(list(paths), wholetext=True)
    names = "|".join(pruned)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("src")).where(~F.col("file").rlike(rf"/({names}|\.[^/]+)/"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the text of their file, empty if it is missing."""
    s = sources.select("file", F.col("src").alias("src"))
    return rows.join(s, "file", "left").withColumn("src", F.coalesce("src", F.lit("")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object over several lines, by an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_routes(spark: SparkSession, path: str, route: str) -> DataFrame:
    """Routes from an array of them, or from an object of arrays by file; ``route`` is the type of one, such as ``struct<method:string,path:string>``."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    rows = F.when(F.ltrim("j").startswith("["), F.from_json("j", f"array<{route}>")).otherwise(F.flatten(F.map_values(F.from_json("j", f"map<string,array<{route}>>"))))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_json_dir(spark: SparkSession, folder: str) -> DataFrame:
    """entity (the file's name) and json (its text) of each ``.json`` file of a folder."""
    df = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("entity"), F.col("value").alias("json"))


def read_entities(spark: SparkSession, folder: str, entities: DataFrame) -> DataFrame:
    """The documents of the wanted entities; one without a file has no row."""
    return read_json_dir(spark, folder).join(entities.select("entity").distinct(), "entity", "left_semi")
