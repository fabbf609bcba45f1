"""Deterministic enrichment and OpenAPI operations as column expressions; schema fragments are JSON strings until the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import camel_id, col, filled, first_tag, is_route, path_template, snake_id, static_summary, tags
from weftline.functions.source_text import body_fields, body_schema, example_value, handler_code, header_parameters, output_fields, present_in, query_fields

#: Code, description, and the methods that have it (None: all).
RESPONSES = (
    ("200", "OK", None),
    ("201", "Created", ("POST",)),
    ("400", "Bad Request - Validation error", ("POST", "PUT", "PATCH", "DELETE")),
    ("401", "Unauthorized - Authentication required", None),
    ("403", "Forbidden - Insufficient permissions", None),
    ("404", "Not Found", None),
    ("409", "Conflict - Resource already exists", ("POST", "PUT")),
    ("500", "Internal Server Error", None),
)
PIPELINE_RESPONSES = (("200", "Success"), ("404", "Not found"), ("500", "Server error"))
FILLED_RESPONSES = (("200", "Successful response"), ("400", "Bad request"), ("401", "Unauthorized"), ("500", "Internal server error"))
WITH_BODY = ("POST", "PUT", "PATCH")
PARAM = "struct<name:string,in:string,required:boolean,type:string,description:string>"


def quoted(x: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def json_object(entries: Column) -> Column:
    """A JSON object of an array of structs key, value (JSON)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def string_schema(fields: Column) -> Column:
    return F.concat(F.lit('{"type":"object","properties":'), json_object(F.transform(fields, lambda x: F.struct(x.alias("key"), F.lit('{"type":"string"}').alias("value")))), F.lit("}"))


def default_responses(method) -> Column:
    """Map of code to description by method."""
    m = F.upper(col(method))
    entries = []
    for code, text, methods in RESPONSES:
        value = F.struct(F.lit(code).alias("key"), (F.when(m.isin("POST", "PUT", "PATCH", "DELETE"), "Success").otherwise(text) if code == "200" else F.lit(text)).alias("value"))
        entries.append(value if methods is None else F.when(m.isin(*methods), value))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def with_defaults(responses) -> Column:
    """The responses, and the usual codes that they lack."""
    defaults = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.lit(t).alias("value")) for c, t in FILLED_RESPONSES]))
    own = F.coalesce(col(responses), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    return F.map_concat(own, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)))


def pipeline_responses(output) -> Column:
    """The three default responses (JSON) of a route, with its output schema (JSON) if there is one."""
    content = F.concat(F.lit(',"content":{"application/json":{"schema":'), F.coalesce(filled(output), F.lit('{"type":"object"}')), F.lit("}}"))
    parts = [F.concat(F.lit(f'"{code}":{{"description":"{text}"'), content if code == "200" else F.lit(""), F.lit("}")) for code, text in PIPELINE_RESPONSES]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def chosen_output(provider, fields) -> Column:
    """The output schema (JSON): the provider's if it has properties, else one of the parsed fields, else an empty object."""
    own = F.get_json_object(col(provider), "$.outputSchema")
    properties = F.from_json(F.get_json_object(own, "$.properties"), "map<string,string>")
    return F.when(F.size(F.map_keys(properties)) > 0, own).otherwise(string_schema(F.coalesce(col(fields), F.array().cast("array<string>"))))


def merged_input(method, path_params, query_params, body_fields, provider) -> Column:
    """path and query (maps of name to JSON schema) and body (JSON schema or null): the parsed names, overruled by the provider's inputSchema (JSON). A GET has no body;
    else the provider's body stands before one of the parsed fields."""

    def named(names, required):
        entry = F.lit('{"type":"string","required":' + required + "}")
        return F.map_from_entries(F.transform(F.array_distinct(F.coalesce(col(names), F.array().cast("array<string>"))), lambda x: F.struct(x, entry)))

    def overruled(own, part):
        given = F.coalesce(F.from_json(F.get_json_object(col(provider), f"$.inputSchema.{part}"), "map<string,string>"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
        return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k)), given)

    fields = F.coalesce(col(body_fields), F.array().cast("array<string>"))
    body = F.coalesce(F.get_json_object(col(provider), "$.inputSchema.body"), F.when(F.size(fields) > 0, string_schema(fields)))
    return F.struct(overruled(named(path_params, "true"), "path").alias("path"), overruled(named(query_params, "false"), "query").alias("query"), F.when(F.upper(F.coalesce(col(method), F.lit("GET"))) != "GET", body).alias("body"))


def provider_first(provider, field: str, *others) -> Column:
    """A field of an operation: the provider's (JSON), else the first of the others that is neither null nor empty."""
    given = F.get_json_object(col(provider), f"$.{field}")
    return F.coalesce(F.when(~given.isin("", "[]", "{}", "null", "false"), given), *[filled(o) for o in others])


def routes_as_docs(routes_json: DataFrame, column: str = "json") -> DataFrame:
    """A JSON array of routes as documentation: key, summary, description, parameters, request_body, responses, tags (JSON), raw. A row that is no such array gives nothing."""
    each = routes_json.select(F.posexplode(F.from_json(column, "array<string>")).alias("ord", "route"))

    def first(*paths, default=None):
        found = F.coalesce(*[F.when(F.get_json_object("route", p) != "", F.get_json_object("route", p)) for p in paths])
        return found if default is None else F.coalesce(found, F.lit(default))

    key = F.concat_ws(" ", F.upper(first("$.method", default="GET")), first("$.path", "$.fullPath", default="/"))
    rows = each.where("route is not null").select(
        "ord", key.alias("key"), first("$.swagger.summary", "$.description", default="").alias("summary"), first("$.swagger.description", "$.docBlock", default="").alias("description"),
        first("$.swagger.parameters", "$.parameters", default="[]").alias("parameters"), first("$.swagger.requestBody").alias("request_body"),
        first("$.swagger.responses", "$.responses", default="{}").alias("responses"), first("$.swagger.tags", "$.tags", default="[]").alias("tags"), first("$.jsdoc", "$.docBlock", default="").alias("raw"))
    fields = [c for c in rows.columns if c not in ("ord", "key")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*fields), "ord").alias("d")).select("key", "d.*")


def endpoint_model(parsed: DataFrame, column: str = "json") -> DataFrame:
    """Parsed routes (JSON objects) as full endpoint records with their defaults; ``to_json`` of a record and this again give the same record."""
    def at(name, default=None):
        found = F.get_json_object(column, f"$.{name}")
        return found if default is None else F.coalesce(found, F.lit(default))

    swagger = '{"summary":"","description":"","tags":[],"parameters":[],"requestBody":null,"responses":{},"deprecated":false,"security":[]}'
    identity = F.regexp_replace(F.concat_ws("-", at("method"), at("path")), "[^a-zA-Z0-9]", "-")
    return parsed.select(
        identity.alias("id"), at("path").alias("path"), F.upper(at("method")).alias("method"), at("file", "").alias("file"), at("line", "0").cast("int").alias("line"), at("framework", "express").alias("framework"),
        F.coalesce(F.from_json(at("middleware"), "array<string>"), F.array().cast("array<string>")).alias("middleware"), F.coalesce(F.from_json(at("middlewareLines"), "array<int>"), F.array().cast("array<int>")).alias("middlewareLines"),
        at("handler").alias("handler"), at("existingSwagger").alias("existingSwagger"), at("jsdoc").alias("jsdoc"), at("swagger", swagger).alias("swagger"),
        at("existingSwagger").isNotNull().alias("hasExistingDocs"), F.coalesce(F.from_json(at("dependencies"), "array<string>"), F.array().cast("array<string>")).alias("dependencies"), F.coalesce(at("enriched").cast("boolean"), F.lit(False)).alias("enriched"))


def example_body(method, fields) -> Column:
    """A JSON example of a body; null for methods without one."""
    f = col(fields)
    return F.when(F.upper(col(method)).isin(*WITH_BODY) & (F.size(f) > 0), json_object(F.transform(f, lambda x: F.struct(x.alias("key"), example_value(x).alias("value")))))


def example_response(method, path) -> Column:
    p = col(path)
    return F.when(p.contains("stats"), '{"status":"success","data":{"total":0,"byDistrict":[],"byAgeGroup":[]}}').when(p.contains("/") & (F.upper(col(method)) == "GET"), '{"status":"success","data":[],"pagination":{"current_page":1,"per_page":20,"total_items":0}}').otherwise('{"status":"success","data":{}}')


def params_from(names: Column, where: str, required: bool) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(where).alias("in"), F.lit(required).alias("required"), F.lit("string").alias("type"), F.concat(x, F.lit(f" {where} parameter")).alias("description")))


def enriched(routes: DataFrame, sources: DataFrame) -> DataFrame:
    """Routes (file, method, path, middleware, ...) with what their source says: the enrichment without a language model.

    Adds summary, operation_id, tags, security, header_parameters, query_parameters, body (JSON schema), output (JSON schema), responses, examples. Each source
    is read once, in a left join on the file; query fields come from the handler's own code, body fields from the file.
    """
    s = sources.select(F.col("file").alias("_file"), F.coalesce("src", F.lit("")).alias("_src"))
    x = routes.join(s, F.col("file") == F.col("_file"), "left")
    x = x.withColumn("_code", handler_code("_src", "method", "path", 800))
    x = x.withColumns({"_query": present_in(query_fields("_code"), "_code"), "_body": present_in(body_fields("_code"), "_code"), "_out": output_fields("_code"), "_schema": body_schema("_src")})
    mutation = F.upper("method").isin(*WITH_BODY, "DELETE")
    body = F.when(mutation, F.coalesce(F.when(F.col("handler").isNotNull(), F.to_json("_schema")), F.when(F.size("_body") > 0, string_schema(F.col("_body")))))
    empty = F.array().cast(f"array<{PARAM}>")
    return x.withColumns({
        "summary": static_summary("method", "path"), "operation_id": camel_id("method", "path"), "enriched_tags": tags("path"), "security": F.lit("bearerAuth"),
        "header_parameters": F.coalesce(header_parameters("middleware"), empty), "query_parameters": F.coalesce(params_from(F.col("_query"), "query", False), empty),
        "body": body, "output": string_schema(F.col("_out")), "responses": default_responses("method"), "example_body": example_body("method", "_body"), "example_response": example_response("method", "path"),
    }).drop("_file", "_src", "_code", "_query", "_body", "_out", "_schema")


def operations(enriched_routes: DataFrame) -> DataFrame:
    """path, method, operation (JSON): one row for each template and method, the last route by file and order counting."""
    path_params = params_from(F.regexp_extract_all("path", F.lit(r":(\w+)"), F.lit(1)), "path", True)
    params = F.concat("header_parameters", path_params, "query_parameters")
    shown = F.transform(params, lambda p: F.concat(F.lit('{"name":'), quoted(p["name"]), F.lit(',"in":'), quoted(p["in"]), F.lit(',"required":'), F.coalesce(p["required"], F.lit(True)).cast("string"), F.lit(',"schema":{"type":'), quoted(F.coalesce(p["type"], F.lit("string"))), F.lit('},"description":'), quoted(p["description"]), F.lit("}")))
    responses = json_object(F.transform(F.array_sort(F.map_entries("responses")), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "200", F.concat(F.lit('{"description":'), quoted(e["value"]), F.lit(',"content":{"application/json":{"schema":'), F.col("output"), F.lit("}}}"))).otherwise(F.concat(F.lit('{"description":'), quoted(e["value"]), F.lit("}"))).alias("value"))))
    plain = F.concat_ws(" ", F.lit("Endpoint"), "method", "path")
    own_body = F.when(F.upper("method").isin(*WITH_BODY), F.concat(F.lit(',"requestBody":{"required":true,"content":{"application/json":{"schema":'), F.coalesce("body", F.lit('{"type":"object","properties":{}}')), F.lit("}}}")))
    tag_list = F.concat(F.lit("["), F.array_join(F.transform("enriched_tags", quoted), ","), F.lit("]"))
    operation = F.concat(
        F.lit('{"summary":'), quoted(F.coalesce(filled("summary"), plain)), F.lit(',"description":'), quoted(F.coalesce(filled("description"), plain)) if "description" in enriched_routes.columns else quoted(plain),
        F.lit(',"operationId":'), quoted(snake_id("method", "path")), F.lit(',"tags":'), tag_list, F.lit(',"parameters":['), F.array_join(shown, ","), F.lit("]"), F.coalesce(own_body, F.lit("")), F.lit(',"responses":'), responses, F.lit(',"security":[{"bearerAuth":[]}]}'))
    rows = enriched_routes.where(is_route("method", "path")).select(path_template("path").alias("path"), F.lower("method").alias("method"), operation.alias("operation"), "enriched_tags", F.struct("file", "ord").alias("_o"))
    return rows.groupBy("path", "method").agg(F.max_by(F.struct("operation", "enriched_tags"), "_o").alias("x")).select("path", "method", "x.operation", F.col("x.enriched_tags").alias("tags"))


def document(ops: DataFrame, title: str = "Generated API Documentation") -> DataFrame:
    """One row, document: the OpenAPI JSON of one project's operations. Paths are nested only here."""
    methods = ops.groupBy("path").agg(json_object(F.array_sort(F.collect_list(F.struct(F.col("method").alias("key"), F.col("operation").alias("value"))))).alias("value"))
    paths = methods.agg(json_object(F.array_sort(F.collect_list(F.struct(F.col("path").alias("key"), "value")))).alias("paths"))
    head = '{"openapi":"3.0.0","info":{"title":"' + title.replace('"', "'") + '","version":"1.0.0","description":"Generated from source"},"paths":'
    tail = ',"components":{"schemas":{},"securitySchemes":{"bearerAuth":{"type":"http","scheme":"bearer","bearerFormat":"JWT"}}}}'
    return paths.select(F.concat(F.lit(head), "paths", F.lit(tail)).alias("document"))


def tag_registry(ops: DataFrame) -> DataFrame:
    """Distinct tags, a description, and the first path at which each is seen."""
    return ops.select(F.explode("tags").alias("tag"), "path").groupBy("tag").agg(F.min("path").alias("first_path")).select("tag", F.concat("tag", F.lit(" endpoints")).alias("description"), "first_path")


def request_body(content, schema) -> Column:
    """JSON of a request body: a given content passes as it is, a schema is wrapped, none is an empty object."""
    wrapped = F.concat(F.lit('{"required":true,"content":{"application/json":{"schema":'), F.coalesce(col(schema), F.lit('{"type":"object","properties":{}}')), F.lit("}}}"))
    return F.coalesce(F.concat(F.lit('{"required":true,"content":'), col(content), F.lit("}")), wrapped)


def default_tags(path) -> Column:
    return F.array(first_tag(path))


def flattened(documents: DataFrame, column: str = "json") -> DataFrame:
    """Documents (JSON text) with nested paths to one row for each operation: path, method, operation (JSON)."""
    paths = documents.select("*", F.explode(F.from_json(F.get_json_object(column, "$.paths"), "map<string,string>")).alias("path", "_methods"))
    rows = paths.select("*", F.explode(F.from_json("_methods", "map<string,string>")).alias("method", "operation"))
    return rows.drop("_methods").where(F.lower("method").isin("get", "post", "put", "delete", "patch", "head", "options"))


def split_parameters(operation: Column | str) -> Column:
    """An operation's (JSON) parameters by location: header, path, query arrays and the last body."""
    params = F.coalesce(F.from_json(F.get_json_object(col(operation), "$.parameters"), "array<struct<name:string,in:string,required:boolean,type:string,description:string,schema:string>>"), F.array().cast("array<struct<name:string,in:string,required:boolean,type:string,description:string,schema:string>>"))

    def at(where):
        return F.filter(params, lambda p: p["in"] == where)

    return F.struct(at("header").alias("header"), at("path").alias("path"), at("query").alias("query"), F.try_element_at(at("body"), F.lit(-1)).alias("body"))


def response_descriptions(operation: Column | str) -> Column:
    """Map of code to description, schema and examples (JSON)."""
    raw = F.from_json(F.get_json_object(col(operation), "$.responses"), "map<string,string>")
    return F.transform_values(raw, lambda _, v: F.struct(F.get_json_object(v, "$.description").alias("description"), F.get_json_object(v, "$.schema").alias("schema"), F.get_json_object(v, "$.examples").alias("examples")))


def schema_registry(definitions: DataFrame) -> DataFrame:
    """``definitions(name, schema, ord)`` to the last schema (JSON) of each name."""
    return definitions.groupBy("name").agg(F.max_by("schema", "ord").alias("schema"))


def with_schemas(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """A document with the registered schemas among its components; both sides have one project's rows."""
    schemas = registry.agg(json_object(F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.col("schema").alias("value"))))).alias("_schemas"))
    one = documents.withColumn("_one", F.lit(1)).join(schemas.withColumn("_one", F.lit(1)), "_one")
    return one.select(F.replace("document", F.lit('"components":{"schemas":{}'), F.concat(F.lit('"components":{"schemas":'), "_schemas")).alias("document"))


def extraction_totals(operations: DataFrame) -> DataFrame:
    """entity, operations, with_parameters, with_body, responses for each entity and, as ``all``, in total. operations: entity, operation (JSON)."""
    o = F.col("operation")
    rows = operations.select("entity", F.get_json_object(o, "$.parameters[0]").isNotNull().alias("p"), F.get_json_object(o, "$.requestBody").isNotNull().alias("b"), F.size(F.coalesce(F.map_keys(F.from_json(F.get_json_object(o, "$.responses"), "map<string,string>")), F.array())).alias("r"))
    return rows.rollup("entity").agg(F.count("*").alias("operations"), F.count_if("p").alias("with_parameters"), F.count_if("b").alias("with_body"), F.sum("r").alias("responses")).withColumn("entity", F.coalesce("entity", F.lit("all")))
