"""Groups, counts, ratios and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import col


def grouped(df: DataFrame, key: Column, name: str, fields: list[str], order: list[str], default: str | None = None) -> DataFrame:
    """Each key's rows as an ordered array of structs. Groups are as long as what a nested sink holds of one key."""
    k = key if default is None else F.coalesce(key, F.lit(default))
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{o}") for o in order], *fields)))
    return df.groupBy(k.alias(name)).agg(rows.alias("_rows")).select(name, F.transform("_rows", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("rows"))


def nested(df: DataFrame, outer: str, inner: str, value: str, order: list[str]) -> DataFrame:
    """outer and a map of inner to value; of rows with one pair the last counts."""
    last = df.groupBy(outer, inner).agg(F.max_by(value, F.struct(*order)).alias(value))
    return last.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, value)))).alias("entries"))


def counted(df: DataFrame, key: Column, name: str = "entity") -> DataFrame:
    """Rows of each key that isn't null."""
    return df.withColumn(name, key).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, values: str, name: str, order: str) -> DataFrame:
    """Distinct members of an array column with the least order at which they occur."""
    return df.select(order, F.explode(values).alias(name)).groupBy(name).agg(F.min(order).alias("first_seen"))


def weighted_mean(score, weight) -> Column:
    return F.coalesce(F.sum(col(score) * col(weight)) / F.nullif(F.sum(F.when(col(score).isNotNull(), col(weight))), F.lit(0.0)), F.lit(0.0))


def mean_skipping_zeros(x) -> Column:
    return F.coalesce(F.avg(F.nullif(col(x), F.lit(0.0))), F.lit(0.0))


def mean_of_successes(x, success) -> Column:
    return F.coalesce(F.avg(F.when(col(success), col(x))), F.lit(0.0))


def capped_ratio(actual, expected) -> Column:
    return F.least(col(actual) / F.nullif(col(expected), F.lit(0)), F.lit(1.0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)))
