"""Operations, documents, paths and ids."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import openapi, paths, source_text
from weftline.plans import fixtures, project


def value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("/api/users/:id", "/api/users/{id}"), ("/api/*", "/api/{wildcard}"), ("", "/"), ("/a/:b/c/:d", "/a/{b}/c/{d}")])
def test_path_template(spark, path, want):
    assert value(spark, paths.path_template("p"), p=path) == want
    assert value(spark, paths.path_template(paths.path_template("p")), p=path) == want


@pytest.mark.parametrize(("path", "tag"), [("/api/users", "users"), ("/api/crm/zone", "crm"), ("/", "default"), ("/v1/x", "v")])
def test_first_tag(spark, path, tag):
    assert value(spark, paths.first_tag("p"), p=path) == tag


def test_ids(spark):
    assert value(spark, paths.snake_id("m", "p"), m="GET", p="/api/users/:id") == "get_api_users_id"
    assert value(spark, paths.camel_id("m", "p"), m="POST", p="/api/user-groups") == "createUserGroups"
    assert value(spark, paths.camel_id("m", "p"), m="GET", p="/api/users/:id") == "getItem"
    assert value(spark, paths.endpoint_id("m", "p"), m="GET", p="/a/:b") == "GET--a--b"
    assert value(spark, paths.static_summary("m", "p"), m="DELETE", p="/api/users") == "Delete user"
    assert value(spark, paths.path_without_groups("p"), p="/a/:id(\\d+)") == "/a/{id}"
    assert value(spark, paths.entity("e"), e="GET /api/crm/Zones/:id") == "zones"
    assert value(spark, paths.entity("e"), e="GET /other") is None


def test_responses(spark):
    assert set(value(spark, openapi.with_defaults(F.create_map(F.lit("200"), F.lit("x"))))) == {"200", "400", "401", "500"}
    assert set(value(spark, openapi.default_responses("m"), m="POST")) == {"200", "201", "400", "401", "403", "404", "409", "500"}
    assert set(value(spark, openapi.default_responses("m"), m="get")) == {"200", "401", "403", "404", "500"}


def test_request_body_keeps_content(spark):
    given = '{"application/json":{"schema":{"$ref":"#/components/schemas/User"}}}'
    assert json.loads(value(spark, openapi.request_body("c", "s"), c=given, s=None))["content"] == json.loads(given)


def test_document_is_json(spark):
    doc = json.loads(project.openapi(fixtures.sources(spark)).first().document)
    assert set(doc["paths"]) > {"/api/crm/users", "/api/crm/users/{id}", "/api/crm/zones/", "/api/crm/zones/{id}"}
    post, get = doc["paths"]["/api/crm/users"]["post"], doc["paths"]["/api/crm/users"]["get"]
    assert "requestBody" in post and "requestBody" not in get
    assert set(post["requestBody"]["content"]["application/json"]["schema"]["properties"]) == {"name", "email"}
    assert {"name": "id", "in": "path", "required": True} == {k: doc["paths"]["/api/crm/users/{id}"]["delete"]["parameters"][1][k] for k in ("name", "in", "required")}
    assert get["parameters"][0]["name"] == "Authorization" and "500" in get["responses"]


def test_flatten_gives_the_operations_back(spark):
    doc = project.openapi(fixtures.sources(spark)).withColumnRenamed("document", "json")
    flat = openapi.flattened(doc)
    assert flat.where("path = '/api/crm/users'").count() == 2
    assert flat.select(F.size(openapi.split_parameters("operation")["header"]).alias("n")).agg(F.max("n")).first()[0] == 1


def test_source_text(spark):
    code = "const { a = 1, b } = req.query; req.query.c; const { d } = req.body; req.body.e; res.json({ ok: 1, id: 2 })"
    assert value(spark, source_text.query_fields("s"), s=code) == ["c", "a", "b"]
    assert value(spark, source_text.body_fields("s"), s=code) == ["e", "d"]
    assert value(spark, source_text.output_fields("s"), s=code) == ["ok", "id"]
    assert value(spark, source_text.body_schema("s"), s="nothing") is None
    assert value(spark, source_text.http_calls("s"), s="fetch('u'); axios.put(`v`)") == [("v", "PUT"), ("u", "GET")]
    assert value(spark, source_text.apidoc("s"), s=" * @apiDescription one\n *  two\n *\n * @apiParam {Number} id The id\n").params[0].name == "id"
    assert value(spark, source_text.repaired_json("s").isNull(), s="no json") is True
    assert value(spark, F.try_variant_get(source_text.repaired_json("s"), "$.a", "int"), s='text {"a": 4} more') == 4


def test_handler_code_stops_at_the_next_route(spark):
    src = "router.get('/a', h1)\n" + "x" * 120 + "\nrouter.get('/b', h2)\n"
    got = value(spark, source_text.handler_code("s", F.lit("GET"), F.lit("/a"), 800), s=src)
    assert "h1" in got and "h2" not in got
    assert value(spark, source_text.handler_code("s", F.lit("GET"), F.lit("/none"), 10), s=src) == src[:10]


def test_inputs_outputs_and_defaults_of_a_provider(spark):
    from pyspark.sql import functions as F

    from weftline.functions import openapi

    provider = '{"summary":"Theirs","tags":[],"inputSchema":{"path":{"id":{"type":"integer"}},"body":{"type":"array"}},"outputSchema":{"type":"object","properties":{"n":{"type":"integer"}}}}'
    df = spark.createDataFrame([(1, "POST", provider), (2, "post", None), (3, "GET", provider), (4, "PUT", '{"outputSchema":{"properties":{}}}')], "k int, method string, provider string")
    names = F.array(F.lit("id")), F.array(F.lit("q")), F.array(F.lit("name"))
    rows = df.select("k", openapi.merged_input("method", *names, "provider").alias("i"), openapi.chosen_output("provider", names[2]).alias("o"), openapi.provider_first("provider", "summary", F.lit(""), F.lit("own")).alias("s"), openapi.provider_first("provider", "tags", F.lit("t")).alias("t"))
    got = {r.k: r for r in rows.collect()}
    assert [json.loads(got[k].i.path["id"])["type"] for k in (1, 2)] == ["integer", "string"] and json.loads(got[2].i.query["q"]) == {"type": "string", "required": False}
    assert json.loads(got[1].i.body) == {"type": "array"} and list(json.loads(got[2].i.body)["properties"]) == ["name"] and got[3].i.body is None
    assert [list(json.loads(got[k].o)["properties"]) for k in (1, 2, 4)] == [["n"], ["name"], ["name"]]
    assert [(got[k].s, got[k].t) for k in (1, 2)] == [("Theirs", "t"), ("own", "t")]
    responses = json.loads(df.select(openapi.pipeline_responses(F.lit(None).cast("string")).alias("r")).first().r)
    assert list(responses) == ["200", "404", "500"] and responses["200"]["content"]["application/json"]["schema"] == {"type": "object"}


def test_routes_as_docs_and_models(spark):
    from pyspark.sql import functions as F

    from weftline.functions import openapi

    routes = [{"method": "get", "path": "/a", "description": "own", "swagger": {"summary": "", "tags": ["x"]}}, {"fullPath": "/b", "docBlock": "raw"}, {"method": "get", "path": "/a", "swagger": {"summary": "S"}}]
    df = spark.createDataFrame([(json.dumps(routes),), ("no json",), (None,)], "json string")
    got = {r.key: r for r in openapi.routes_as_docs(df).collect()}
    assert set(got) == {"GET /a", "GET /b"} and got["GET /a"].summary == "S" and got["GET /b"].description == got["GET /b"].raw == "raw" and got["GET /b"].parameters == "[]"
    parsed = spark.createDataFrame([('{"method":"get","path":"/a/:id","line":7,"middleware":["auth"]}',)], "json string")
    once = openapi.endpoint_model(parsed)
    row = once.first()
    assert (row.id, row.method, row.line, row.framework, row.middleware, row.hasExistingDocs) == ("get--a--id", "GET", 7, "express", ["auth"], False)
    again = openapi.endpoint_model(once.select(F.to_json(F.struct("*")).alias("json"))).first()
    assert again.asDict() | {"id": row.id} == row.asDict()
