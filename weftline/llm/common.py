"""What the training-data operators share: tables, words, splits and written intermediate tables."""

from __future__ import annotations

import getpass
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a Java, Python and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = SPACE_CLASS + "+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Only in local mode, where all is one machine, one is made if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    return f"{tempfile.gettempdir()}/weftline-{getpass.getuser()}"


def written(df: DataFrame, label: str, **conf: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here and lost executors cost nothing.

    The shuffle files of the write aren't needed again, so Spark is told to remove them when it ends. conf: further settings, dots written as two
    underscores, that hold for the write only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def place_in_file(df: DataFrame, columns) -> DataFrame:
    """``df.select(*columns(place))``. place names a row by its file and its number there, the same whenever the file is read, so equal rows can be told apart;
    it is an empty string where rows don't come straight from files."""
    try:
        return df.select(*columns(F.concat_ws(":", "_metadata.file_name", "_metadata.row_index")))
    except AnalysisException:
        return df.select(*columns(F.lit("")))


def from_files(df: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """``df`` if its rows come straight from files, else written to files; the second is what to discard in the end."""
    try:
        df.select("_metadata.row_index")
        return df, []
    except AnalysisException:
        df = written(df, label)
        return df, [df]


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker doesn't hold what its last group took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def words(text: str | Column) -> Column:
    """The words of a text as an array; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACES), "")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string")), F.lit(modulus)), F.lit(0))


def drawn_by_hash(labelled: DataFrame, label: str, key: str, sample, least: int = 0, bits: int = 30, seed: int = 0) -> DataFrame:
    """``labelled`` with the column h, a hash of ``key``: of each label the distinct keys of the lowest hashes, all other columns the least ones.

    A label gives ``sample(number of labels)`` of them, ``least`` at least, or all it has: rates come from estimated counts of distinct keys with room to
    spare, and ranks over what was drawn cut the rest, so copies starve no label and the windows see rows bounded by the sample and the number of labels.
    """
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << bits))
    labelled = labelled.withColumn("h", h)
    counts = written(labelled.groupBy(F.col(label).alias("_of")).agg(F.approx_count_distinct(F.xxhash64(key)).alias("_n")), "label-counts")
    want = max(least, int(sample(max(1, counts.count()))))
    room = 2 * want + 50
    limits = counts.select("_of", F.least(F.lit(1 << bits), F.ceil(F.lit(float(room << bits)) / F.greatest("_n", F.lit(1)))).alias("_limit"))
    some = labelled.join(F.broadcast(limits), F.col(label) == F.col("_of")).where("h < _limit").drop("_of", "_limit")
    rest = [c for c in labelled.columns if c not in (label, key, "h")]
    once = some.groupBy(label, "h", key).agg(*[F.min(c).alias(c) for c in rest]) if rest else some.select(label, "h", key).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h", key))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= want).drop("_rank")


def column_bytes(column) -> list:
    """The values of an Arrow string column as bytes, nulls as None."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch, most_bytes: int, by: str = "text"):
    """An Arrow batch in slices of about ``most_bytes`` of the column ``by``, each of one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    column = batch.column(by)
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())), 0)
    part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
