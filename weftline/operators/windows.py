"""Carry-forward, progress, spans and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(value: Column, by: list[str], order: list) -> Column:
    """The last value that isn't null, up to the current row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def span_end(position: Column, by: list[str], order: list) -> Column:
    """Where the next row of the key starts."""
    return F.lead(position).over(Window.partitionBy(*by).orderBy(*order))


def progress(df: DataFrame, by: list[str], order: list) -> DataFrame:
    line = Window.partitionBy(*by)
    return df.withColumns({"done": F.row_number().over(line.orderBy(*order)), "total": F.count("*").over(line)})


def ranked(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Places over a short list such as one row for each model."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
