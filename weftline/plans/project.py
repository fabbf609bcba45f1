"""From source files to routes with documentation, dependencies, enrichment, an OpenAPI document, a comparison and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.comments import extract_comments, swagger_operations, swagger_spans
from weftline.functions.javascript import extract_routes, route_positions
from weftline.functions.openapi import document, enriched, operations
from weftline.functions.paths import endpoint_id, endpoint_key, entity
from weftline.functions.source_text import database_calls, http_calls, service_calls
from weftline.operators.compare import compare_docs, patches
from weftline.operators.evaluate import route_scores, totals
from weftline.operators.joins import asof_attach

TOLERANCE = 10


def routes(sources: DataFrame) -> DataFrame:
    return extract_routes(sources).withColumn("id", endpoint_id("method", "path"))


def documented_routes(found: DataFrame, comments: DataFrame) -> DataFrame:
    """Routes with the nearest doc block before them, within ten lines: doc_line, doc_summary, doc_description, doc_tags, has_docs."""
    c = comments.select("file", F.col("line").alias("doc_line"), F.col("ord").alias("doc_ord"), F.col("summary").alias("doc_summary"), F.col("description").alias("doc_description"), F.col("tags").alias("doc_tags"))
    out = asof_attach(found, c, ["file"], "line", "doc_line", "doc_ord", TOLERANCE, ["doc_summary", "doc_description", "doc_tags"])
    return out.withColumn("has_docs", F.col("doc_line").isNotNull())


def relationships(found: DataFrame, sources: DataFrame) -> DataFrame:
    """endpoint, database, services, external: dependencies are those of the whole file, found once for each file."""
    by_file = sources.select("file", database_calls("src").alias("database"), service_calls("src").alias("services"), http_calls("src").alias("external"))
    return found.join(by_file, "file").select(endpoint_key("method", "path").alias("endpoint"), "file", "ord", "database", "services", "external")


def edges(related: DataFrame) -> DataFrame:
    """The same as a table of edges: endpoint, kind, target."""

    def named(kind, found):
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    targets = F.concat(named("table", F.col("database")), named("service", F.col("services")), named("url", F.transform("external", lambda x: x["url"])))
    return related.select("endpoint", F.explode(targets).alias("e")).select("endpoint", "e.kind", "e.target").distinct()


def with_entity(related: DataFrame) -> DataFrame:
    return related.withColumn("entity", entity("endpoint"))


def openapi(sources: DataFrame) -> DataFrame:
    return document(operations(enriched(routes(sources), sources)))


def comparison(sources: DataFrame) -> DataFrame:
    """Generated operations against the ``@swagger`` blocks of the same sources."""
    return compare_docs(generated_docs(sources), original_docs(sources))


def generated_docs(sources: DataFrame) -> DataFrame:
    e = enriched(routes(sources), sources)
    params = F.transform(F.concat("header_parameters", "query_parameters"), lambda p: p["name"])
    body = F.coalesce(F.map_keys(F.from_json(F.get_json_object("body", "$.properties"), "map<string,string>")), F.array().cast("array<string>"))
    return e.select("method", "path", "summary", F.lit(None).cast("string").alias("description"), params.alias("params"), body.alias("body"), F.map_keys("responses").alias("responses"), F.col("enriched_tags").alias("tags"))


def original_docs(sources: DataFrame) -> DataFrame:
    ops = swagger_operations(sources)
    return ops.select("method", "path", F.nullif("summary", F.lit("")).alias("summary"), F.nullif("description", F.lit("")).alias("description"), F.transform("parameters", lambda p: p["name"]).alias("params"), F.array().cast("array<string>").alias("body"), F.map_keys("responses").alias("responses"), F.struct("file", "ord").alias("ord"))


def project_patches(sources: DataFrame) -> DataFrame:
    return patches(generated_docs(sources), swagger_spans(sources), routes(sources), route_positions(sources))


def evaluation(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Totals of each case. A case with an expected document, but no expected routes, is scored by its document alone."""
    found = documented_routes(routes(cases), extract_comments(cases))
    actual = found.select(F.col("file").alias("case"), "ord", "path", "method", F.size("middleware").alias("middleware"), "framework", "has_docs", F.col("doc_summary").alias("summary"))
    by_routes = route_scores(actual, expected)
    ops = operations(enriched(routes(cases), cases).withColumn("path", F.concat("file", F.lit("|"), "path")))
    rest = ops.select(F.split("path", r"\|")[0].alias("case"), F.get_json_object("operation", "$.summary").alias("s")).join(expected.select("case").distinct(), "case", "left_anti")
    by_document = rest.groupBy("case").agg((F.count_if(F.col("s") != "") / F.count("*")).alias("complete"), F.lit(1.0).alias("valid"))
    by_document = by_document.select("case", F.explode(F.array(F.struct(F.lit("generation").alias("category"), F.lit("openapiValidity").alias("criterion"), F.col("valid").alias("score")), F.struct(F.lit("generation").alias("category"), F.lit("schemaCompleteness").alias("criterion"), F.col("complete").alias("score")))).alias("x")).select("case", "x.*")
    return totals(by_routes.unionByName(by_document))


def summary_rows(documented: DataFrame) -> DataFrame:
    """One short row for each route."""
    return documented.select("method", "path", "file", "line", "framework", F.coalesce("handler.name", F.lit("anonymous")).alias("handler"), F.size("middleware").alias("middleware_count"), F.size(F.coalesce("handler.params", F.array())).alias("params"), "has_docs")


def find_route(found: DataFrame, method: str, fragment: str) -> DataFrame:
    """The first route of a method whose path holds the fragment."""
    return found.where((F.upper("method") == method.upper()) & F.col("path").contains(fragment)).orderBy("file", "ord").limit(1)
