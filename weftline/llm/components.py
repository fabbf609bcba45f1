"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, written


def _hung(neighbours: DataFrame, keep_self: bool) -> DataFrame:
    """Hang the neighbours v of each u from the smallest of them and u. The minimum is pre-aggregated, so a hub isn't gathered in one task."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = neighbours.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_self:
        hung = hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(node, component)``, the component being its smallest node.

    Each round is written to the shared folder, so it neither grows the lineage nor gathers anything on the driver but one count and sum.
    Nodes without an edge to another node don't appear. Nulls, loops and repeated edges are dropped. No edges give no rows.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = written(ordered(edges.where("a is not null and b is not null and a <> b")), "edges")
    state = None
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: only larger neighbours move; small star: the smaller ones and the node itself
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _hung(ordered(large).select(F.col("a").alias("u"), F.col("b").alias("v")), keep_self=True)
        before, current = current, written(ordered(small), "edges")
        discard(before)
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out.written_at = current.written_at  # the table that it reads, for ``discard``
    return out
