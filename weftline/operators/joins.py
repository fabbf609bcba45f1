"""Joins: as-of with a tolerance, last-wins enrichment, two keys, first match, pending and documented rows, expected and actual.

Each is an equi-join or one aggregation, so Catalyst and adaptive execution choose between broadcast and shuffle by size and split skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def asof_attach(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, right_order: str, tolerance: int, values: list[str]) -> DataFrame:
    """Adds to each left row the ``values`` of the right row of the same ``by`` that is nearest before it, or at it; null if farther than ``tolerance``.

    Places are whole numbers. A row before is preferred over one at the same place even if it then is too far; of rows at one place the first by
    ``right_order`` counts. Places are cut into buckets of the tolerance's length and right rows are copied into their own bucket and the next one, so a
    window sees the rows of one key and bucket only: a key with many rows is dealt to as many tasks as it has buckets, and no pairs are made.
    """
    width = F.lit(int(tolerance) + 1)
    first = right.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(right_at).alias("_first"))
    same_key = [F.col(c) == F.col(f"_by_{c}") for c in by]
    own = left.join(first, same_key, "left")
    kind = right.select(F.struct(right_at, *values).alias("s")).schema["s"].dataType
    own = own.select(F.struct(*left.columns).alias("_left"), *by, F.col(left_at).cast("long").alias("_at"), "_first", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_right"), F.floor(F.col(left_at) / width).alias("_bucket"))
    other = right.groupBy(*by, F.col(right_at).alias("_place")).agg(F.min_by(F.struct(right_at, *values), right_order).alias("_right"))
    bucket = F.floor(F.col("_place") / width)
    other = other.select(F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), *by, F.col("_place").cast("long").alias("_at"), F.lit(None).cast(own.schema["_first"].dataType).alias("_first"), F.lit(0).alias("_side"), "_right", F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    strict = Window.partitionBy(*by, "_bucket").orderBy("_at", F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)  # left rows come before right rows of their place
    same = Window.partitionBy(*by, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(other).withColumns({"_before": F.last("_right", ignorenulls=True).over(strict), "_same": F.last("_right", ignorenulls=True).over(same)})
    near = F.when(F.col("_at") - F.col(f"_before.`{right_at}`") <= F.lit(int(tolerance)), F.col("_before"))
    here = F.when((F.col(f"_same.`{right_at}`") == F.col("_at")) & ~(F.col("_first") < F.col("_at")), F.col("_same"))
    out = both.where("_side = 1").withColumn("_near", F.coalesce(near, here))
    return out.select("_left.*", *[F.col(f"_near.`{v}`").alias(v if v not in left.columns else f"right_{v}") for v in [right_at, *values]])


def enrich_last_wins(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Left outer join to the last right row of each key."""
    return left.join(last_wins(right, key, order).drop(*[c for c in order if c in left.columns]), key, "left")


def two_key_lookup(left: DataFrame, right: DataFrame, first: Column, second: Column, key: str, values: list[str]) -> DataFrame:
    """``values`` by the first key or else by the second: two equi-joins and coalesce, never an OR condition. Right keys must be distinct."""
    a = right.select(F.col(key).alias("_k1"), F.struct(*values).alias("_a"))
    b = right.select(F.col(key).alias("_k2"), F.struct(*values).alias("_b"))
    joined = left.withColumns({"_f": first, "_s": second}).join(a, F.col("_f") == F.col("_k1"), "left").join(b, F.col("_s") == F.col("_k2"), "left")
    picked = F.coalesce("_a", "_b")
    return joined.select(*left.columns, *[picked[v].alias(v) for v in values])


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left outer join to the first right row of each normalised key."""
    return left.join(first_wins(right, keys, order), keys, "left")


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return work.join(done.select(*key).distinct(), key, "left_anti")


def documented(routes: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    return routes.join(docs.select(*key), key, "left_semi")


def found_share(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """expected, found and share: how many expected rows have an actual one."""
    hits = expected.join(actual.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hits.agg(F.count("*").alias("expected"), F.count("_hit").alias("found"), F.coalesce(F.count("_hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("share"))
