"""Merges, comparisons, patches, sinks, providers and incremental runs."""

import json

from pyspark.sql import functions as F

from weftline.operators import compare, merge
from weftline.plans import fixtures, project


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "x map<string,int>, y map<string,int>")
    got = df.select(merge.right_wins("x", "y").alias("r"), merge.left_wins("x", "y").alias("l")).first()
    assert got.r == {"a": 1, "b": 3, "c": 4} and got.l == {"a": 1, "b": 2, "c": 4}


def test_merge_rules(spark):
    response = "map<string,struct<description:string,schema:string>>"
    new = spark.createDataFrame([("GET /a", "", None, None, {"200": ("ok", None)}), ("GET /b", "own", None, None, None)], f"key string, description string, security string, body string, responses {response}")
    old = spark.createDataFrame([(1, "GET /a", ["Authorization"], [], ["id"], "B", {"200": ("x", "{}"), "404": ("none", "{}"), "500": ("bad", None)}, ["T"], "text")], f"ord int, key string, header array<string>, query array<string>, path array<string>, body string, responses {response}, tags array<string>, description string")
    rows = {r.key: r for r in merge.merge_endpoints(new, old).collect()}
    a, b = rows["GET /a"], rows["GET /b"]
    assert (a.description, a.security, a.body, a.merged_from_existing) == ("text", "bearerAuth", "B", True)
    assert set(a.responses) == {"200", "404"} and a.responses["200"].description == "ok"
    assert (b.description, b.security, b.body, b.merged_from_existing) == ("own", None, None, False)
    c = merge.coverage(merge.merge_endpoints(new, old)).first()
    assert (c.total, c.merged, c.merged_pct) == (2, 1, 50)


def test_comparison_counts_and_report(spark):
    got = project.comparison(fixtures.sources(spark))
    assert compare.comparison_counts(got).first().asDict() == {"total": 6, "with_original": 1, "improved": 1, "unchanged": 0, "params_improved": 1, "schema_improved": 0, "responses_improved": 1}
    text = compare.markdown_report(got).first().report
    assert "## Improved (1)" in text and "## New (5)" in text
    assert "| with original | 1 |" in text and "| new | 5 |" in text and "(was: List; parameters: Authorization, limit" in text and "## Unchanged" not in text


def test_patches(spark):
    rows = project.project_patches(fixtures.sources(spark)).collect()
    new = [r for r in rows if r.type == "new"]
    assert {(r.method, r.path): r.insert_before_line for r in new}[("DELETE", "/api/crm/users/:id")] == 46
    assert all(r.new_content.startswith("/**\n * @swagger") and r.diff_new.startswith("+ 1: /**") for r in new)
    diffs = compare.diffs_by_file(project.project_patches(fixtures.sources(spark))).collect()
    assert {r.file for r in diffs} == {"users.js", "zones.js"}


def test_improved_patch_replaces_the_block(spark):
    g = spark.createDataFrame([("get", "/a", "A much longer summary text", None, ["T"])], "method string, path string, summary string, description string, tags array<string>")
    s = spark.createDataFrame([("f", "GET", "/a", 1, 4, "old", "short")], "file string, method string, path string, start_line int, end_line int, block string, summary string")
    r = spark.createDataFrame([("f", "GET", "/a", 9, 0)], "file string, method string, path string, line int, ord int")
    p = spark.createDataFrame([], "file string, key string, line int, code string")
    got = compare.patches(g, s, r, p).first()
    assert (got.type, got.action, got.start_line, got.end_line, got.diff_old) == ("improved", "replace", 1, 4, "- 1: old")


def test_missing_information(spark):
    fields = "entity string, method string, path string, n_params int, has_body boolean, has_detail boolean, has_examples boolean"
    g = spark.createDataFrame([("e", "get", "/a/:id", 0, False, False, False), ("e", "get", "/new", 0, False, False, False)], fields)
    o = spark.createDataFrame([("e", "GET", "/a/{id}", 2, True, True, True), ("e", "GET", "/old", 0, False, False, False)], fields)
    got = compare.missing_information(g, o).first().asDict()
    assert got == {"total": 2, "compared": 1, "missing_in_original": 1, "missing_in_generated": 1, "missing_parameters": 1, "missing_body": 1, "missing_response_details": 1, "missing_examples": 1}


def test_files_and_sinks(spark, tmp_path):
    from weftline.sources import files, sinks

    (tmp_path / "src" / "__tests__").mkdir(parents=True)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / ".git").mkdir()
    for name in ("a.js", "_f.js", "__tests__/b.js", "node_modules/c.js", ".git/d.js", "e.txt"):
        (tmp_path / "src" / name).write_text(f"router.get('/{name}', h)")
    root = str(tmp_path / "src")
    assert sorted(r.file.removeprefix(root + "/") for r in files.read_sources(spark, root).collect()) == ["__tests__/b.js", "_f.js", "a.js"]
    assert files.walk(root + "/a.js") == [root + "/a.js"] and files.walk(root + "/none") == []
    assert files.scan_sources(spark, root).where("file like '%node_modules%'").count() == 0
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("users", 1), ("users", 2), (None, 3)], "entity string, v int")
    for _ in range(2):
        sinks.write_by_entity(df, out)
    assert [tuple(r) for r in spark.read.json(out + "/summary").select("entity", "count").collect()] == [("users", 2)]
    routes = tmp_path / "routes.json"
    routes.write_text(json.dumps({"f": [{"method": "GET", "path": "/a"}], "g": [{"method": "PUT", "path": "/b"}]}))
    assert files.read_routes(spark, str(routes), "struct<method:string,path:string>").count() == 2
    assert sinks.reset(spark, out) is False and sinks.reset(spark, out, force=True) is True


def test_upsert(spark, tmp_path):
    from weftline.sources import sinks

    path = str(tmp_path / "vectors")
    for v in (1, 2):
        sinks.upsert(spark, spark.createDataFrame([("a", v), (f"b{v}", v)], "id string, v int"), path, ["id"])
    assert {r.id: r.v for r in sinks.current(spark, path, ["id"]).collect()} == {"a": 2, "b1": 1, "b2": 2}


def test_provider_and_fallback(spark):
    from weftline.sources.provider import answered_or_static, available, load_config

    df = spark.createDataFrame([(1, "p1", "own", "d"), (2, "p2", "own", "d")], "id int, prompt string, summary string, description string")

    def ask(prompts):
        return ['said {"summary": "new"}' if p == "p1" else "nothing" for p in prompts]

    assert {r.id: (r.summary, r.from_provider) for r in answered_or_static(df, ask).collect()} == {1: ("new", True), 2: ("own", False)}
    assert {r.summary for r in answered_or_static(df).collect()} == {"own"}
    assert load_config(None)["provider"] == "none" and available(None) is False


def test_resume(spark, tmp_path):
    from weftline.streaming.incremental import run_pending, stream_pending

    path = str(tmp_path / "done")
    work = spark.range(5).select(F.col("id").alias("key"))
    assert run_pending(work, path, ["key"], lambda d: d.withColumn("x", F.lit(1))) == 5
    assert run_pending(spark.range(7).select(F.col("id").alias("key")), path, ["key"], lambda d: d.withColumn("x", F.lit(1))) == 2
    assert run_pending(work, path, ["key"], lambda d: d.withColumn("x", F.lit(1))) == 0
    source = str(tmp_path / "in")
    for n in (3, 6):
        spark.range(n).select(F.col("id").alias("key")).write.mode("append").parquet(source)
        stream_pending(spark, source, "key long", str(tmp_path / "out"), str(tmp_path / "cp"), ["key"], lambda d: d.withColumn("x", F.lit(1))).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_a_repeated_batch_loses_nothing(spark, tmp_path):
    import glob
    import os

    from weftline.streaming.incremental import run_pending, stream_pending

    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream_pending(spark, source, "key long", out, checkpoint, ["key"], lambda d: d.withColumn("x", F.lit(1))).awaitTermination()
        return sorted(r.key for r in spark.read.parquet(out).collect())

    for first, last in ((0, 3), (1, 6)):
        spark.range(first, last).select(F.col("id").alias("key")).write.mode("append").parquet(source)
        assert run() == list(range(last))
    for number in (1, 0):  # the commits are lost after the batches were written
        for f in glob.glob(f"{checkpoint}/commits/{number}") + glob.glob(f"{checkpoint}/commits/.{number}.crc"):
            os.remove(f)
        if number:
            assert run() == list(range(6))
    twice = spark.createDataFrame([(1,), (1,), (2,)], "key long")
    assert run_pending(twice, str(tmp_path / "t"), ["key"], lambda d: d) == 2


def test_originals_by_route_then_method(spark):
    columns = "entity string, method string, path string, n_params int, has_body boolean, has_detail boolean, has_examples boolean"
    g = spark.createDataFrame([("u", "get", "/api/crm/u", 0, False, False, True), ("u", "post", "/api/crm/u/:id", 1, False, True, False), ("u", "put", "/x", 0, False, False, False), ("v", "get", "/v", 0, False, False, False)], columns)
    o = spark.createDataFrame([("u", "get", "/u", 2, False, True, True, 0), ("u", "post", "/other", 1, True, True, True, 1), ("u", "post", "/third", 0, False, False, False, 2)], columns + ", ord int")
    found = {(r.method, r.path): r.original and r.original.path for r in compare.matched_originals(g, o).collect()}
    assert found == {("get", "/api/crm/u"): "/u", ("post", "/api/crm/u/:id"): "/other", ("put", "/x"): None, ("get", "/v"): None}
    lists = sorted((r.category, r.path) for r in compare.missing_lists(g, o).collect())
    assert lists == [("missing_body", "/api/crm/u/:id"), ("missing_examples", "/api/crm/u/:id"), ("missing_in_original", "/v"), ("missing_in_original", "/x"), ("missing_parameters", "/api/crm/u"), ("missing_response_details", "/api/crm/u")]


def test_outputs_of_a_run(spark, tmp_path):
    from weftline.functions.openapi import enriched
    from weftline.sources.sinks import write_results

    s, path = fixtures.sources(spark), str(tmp_path / "run")
    found = project.routes(s)
    write_results(path, found, project.relationships(found, s), enriched(found, s), project.openapi(s))
    by_file = {r.file: len(r.routes) for r in spark.read.json(f"{path}/routes-by-file").collect()}
    assert sum(by_file.values()) == spark.read.json(f"{path}/routes").count() == found.count()
    assert spark.read.text(f"{path}/openapi").first().value.startswith('{"openapi"')


def test_vector_search(spark):
    from weftline.operators.vectors import nearest, nearest_to_each

    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(8)], "id int, embedding array<float>")
    assert [r.id for r in nearest(v, [3.0, 1.0], 2).collect()] == [3, 4]
    q = v.where("id = 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert [r.id for r in nearest_to_each(v, q, 2).orderBy("place").collect()] == [3, 4]
    every = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    one, many = (sorted(tuple(r) for r in nearest_to_each(v, every, 3, block=k).collect()) for k in (100, 3))
    assert one == many and len(one) == 24
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(20, 0, -1)], "id int, embedding array<float>")
    assert [r.id for r in nearest_to_each(same, q, 3).orderBy("place").collect()] == [1, 2, 3]
    assert nearest_to_each(v.limit(0), q, 2).count() == 0
    some = spark.createDataFrame([(k, None if k % 3 == 0 else [float(k % 5), 1.0]) for k in range(40)], "id int, embedding array<float>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a task keeps its nearest over all its batches
    try:
        got = nearest_to_each(some, q.unionByName(spark.createDataFrame([(99, None)], q.schema)), 4).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, r.id) for r in got] == [(3, 8), (3, 13), (3, 23), (3, 28)]


def test_validated_patches_and_request_text(spark):
    found = project.project_patches(fixtures.sources(spark))
    good, missing = compare.validated(found, spark.createDataFrame([("users.js",)], "file string"))
    assert good.count() == found.count() and {r.file for r in missing.collect()} == {"zones.js"}
    text = compare.request_text(found).first().text
    assert text.startswith("## Documentation\nNew: ") and "`DELETE /api/crm/users/:id` in users.js" in text


def test_passes_and_log(spark):
    from weftline.sources.provider import call_log, three_passes

    df = spark.createDataFrame([(1, "p")], "id int, prompt string")

    def ask(name, prompts, tokens):
        if name == "schema":
            raise OSError("down")
        return [f'{{"{name}": {tokens}}}' for _ in prompts]

    got = three_passes(df, ask).first()
    assert (json.loads(got.metadata), got.schema, json.loads(got.responses)) == ({"metadata": 400}, None, {"responses": 500})
    log = call_log(df, spark.createDataFrame([(1, "x" * 3000)], "id int, answer string")).first()
    assert len(log.answer) == 2000 and log.ok is False


def test_registry_and_search(spark):
    from weftline.functions.openapi import schema_registry, with_schemas
    from weftline.operators.vectors import model_text

    names = schema_registry(spark.createDataFrame([("A", "{}", 1), ("A", '{"type":"object"}', 2)], "name string, schema string, ord int"))
    doc = json.loads(with_schemas(project.openapi(fixtures.sources(spark)), names).first().document)
    assert doc["components"]["schemas"] == {"A": {"type": "object"}}
    routes = project.routes(fixtures.sources(spark))
    assert project.find_route(routes, "post", "users").first().ord == 1
    text = routes.where("path = '/api/crm/users/:id'").select(model_text("method", "path", "handler.name", F.lit(""), F.lit(None), F.lit("d" * 600), F.array(), F.array(), F.array(F.lit("S")), "middleware", "framework").alias("t")).first().t
    assert text.split("\n") == ["DELETE /api/crm/users/:id", "Handler: removeUser", "Description: " + "d" * 500, "Services: S", "Middleware: requireAuth", "Framework: express"]
