"""Evaluation of extracted routes against expected ones, weighted scores, and model rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.aggregates import capped_ratio, weighted_mean
from weftline.operators.windows import ranked

#: The weight of each criterion.
WEIGHTS = (
    ("parsing", "routeDetection", 2.0),
    ("parsing", "pathExtraction", 1.5),
    ("parsing", "methodIdentification", 1.5),
    ("parsing", "middlewareExtraction", 1.0),
    ("parsing", "frameworkDetection", 1.0),
    ("swagger", "existingDocsDetection", 2.0),
    ("swagger", "docsParsing", 1.5),
    ("generation", "openapiValidity", 2.0),
    ("generation", "schemaCompleteness", 1.0),
    ("generation", "documentationQuality", 1.0),
    ("enrichment", "parameterInference", 1.5),
    ("enrichment", "responseInference", 1.5),
)
CATEGORIES = ("parsing", "swagger", "generation")
PASS = 0.75


def route_scores(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """``(case, category, criterion, score)`` for the routes of each case.

    actual: case, ord, path, method, middleware (size), framework, has_docs, summary; of routes with one path, or path and method, the first by ord counts. expected: case, path, method, middleware_count, framework, has_docs, summary; a
    case without expected routes has no row. Joins are on (case, path) and (case, path, method).
    """
    a = actual.select("case", "ord", "path", "method", "middleware", "framework", "has_docs", "summary")
    paths = expected.select("case", "path").distinct().withColumn("_p", F.lit(1))
    pairs = expected.select("case", "path", "method").distinct().withColumn("_m", F.lit(1))
    cases = expected.groupBy("case").agg(F.count("*").alias("n"), F.count_if(F.col("middleware_count") > 0).alias("n_mw"), F.count("framework").alias("n_fw"), F.count_if("has_docs").alias("n_docs"))
    hits = a.join(paths, ["case", "path"], "left").join(pairs, ["case", "path", "method"], "left").groupBy("case").agg(F.count("*").alias("found"), F.count("_p").alias("by_path"), F.count("_m").alias("by_pair"), F.count_if("has_docs").alias("documented"))
    one_pair = a.groupBy("case", "path", "method").agg(F.min_by("middleware", "ord").alias("mw"))
    one_path = a.groupBy("case", "path").agg(F.min_by("framework", "ord").alias("fw"), F.min_by(F.struct("has_docs", "summary"), "ord").alias("doc"))
    e = expected.join(one_pair, ["case", "path", "method"], "left").join(one_path, ["case", "path"], "left").groupBy("case").agg(
        F.count_if((F.col("middleware_count") > 0) & (F.col("mw") >= F.col("middleware_count"))).alias("ok_mw"),
        F.count_if(F.col("framework") == F.col("fw")).alias("ok_fw"),
        F.count_if(F.expr("has_docs and doc.has_docs and (summary is null or summary = doc.summary)")).alias("ok_docs"))
    x = cases.join(hits, "case", "left").join(e, "case").na.fill(0, ["found", "by_path", "by_pair", "documented"])

    def share(part, whole, empty=1.0):
        return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(empty))

    scores = (("parsing", "routeDetection", capped_ratio("found", "n")), ("parsing", "pathExtraction", share("by_path", "n")), ("parsing", "methodIdentification", share("by_pair", "n")), ("parsing", "middlewareExtraction", share("ok_mw", "n_mw")), ("parsing", "frameworkDetection", share("ok_fw", "n_fw")), ("swagger", "existingDocsDetection", share("documented", "found", 0.0)), ("swagger", "docsParsing", share("ok_docs", "n_docs")))
    return x.select("case", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("criterion"), v.alias("score")) for c, k, v in scores])).alias("s")).select("case", "s.*")


def totals(scores: DataFrame) -> DataFrame:
    """case, a weighted mean for each category (0 without a score), their plain mean as overall, and whether it passes."""
    weights = scores.sparkSession.createDataFrame(list(WEIGHTS), "category string, criterion string, weight double")
    means = scores.join(F.broadcast(weights), ["category", "criterion"]).groupBy("case", "category").agg(weighted_mean("score", "weight").alias("total"))
    wide = means.groupBy("case").pivot("category", list(CATEGORIES)).agg(F.first("total")).na.fill(0.0, list(CATEGORIES))
    return wide.withColumn("overall", sum(F.col(c) for c in CATEGORIES) / len(CATEGORIES)).withColumn("passed", F.col("overall") >= PASS)


def rankings(results: DataFrame) -> DataFrame:
    """Three leaderboards of ``results(model, success, duration, score, ord)``: by score over all, by speed and combined over successes."""
    combined = F.col("score") * 0.7 + (1 - F.col("duration") / 10000) * 0.3
    won = results.where("success")
    boards = (("score", ranked(results.withColumn("value", F.col("score").cast("double")), [F.desc("value"), "ord"])), ("speed", ranked(won.withColumn("value", F.col("duration").cast("double")), ["value", "ord"])), ("combined", ranked(won.withColumn("value", combined), [F.desc("value"), "ord"])))
    parts = [b.select(F.lit(name).alias("board"), "place", "model", "value") for name, b in boards]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
