"""Doc blocks and their attachment to routes."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.functions.comments import blocks_of, indented_block, parse_block, swagger_index, swagger_spans


def block(*lines):
    return "\n" + "".join(f" * {x}\n" for x in lines)


def test_summary_description_tags():
    got = parse_block(block("@summary Get all users", "@description Returns a list of users", "@tags User, Admin"))
    assert (got["summary"], got["description"], got["tags"]) == ("Get all users", "Returns a list of users", ["User", "Admin"])
    assert parse_block(block("@swagger", "summary: A", "description: B", "tags: 'x', y"))["tags"] == ["x", "y"]


def test_parameters():
    got = parse_block(block("@param {number} id - User ID", "@path {string} [name] - User name"))["parameters"]
    assert [(p["name"], p["type"], p["in"], p["required"], p["description"]) for p in got] == [("id", "number", "query", True, "User ID"), ("name", "string", "path", False, "User name")]


def test_responses_alone_are_enough():
    assert parse_block(block("200: Success", "400: Bad", "500: Worse"))["responses"] == {"200": "Success", "400": "Bad", "500": "Worse"}


def test_prose_is_no_documentation():
    assert parse_block(block("Just words about 2000 items")) is None
    assert parse_block("") is None


def test_deprecated():
    assert parse_block(block("@deprecated since 2"))["deprecated"] is True


def test_two_blocks_have_lines():
    src = "x\n/**\n * @summary A\n */\ny\n/**\n * @summary B\n */\n/** prose */"
    assert [(b["ord"], b["line"], b["summary"]) for b in blocks_of(src)] == [(0, 2, "A"), (1, 6, "B")]


def test_spans_and_indented_form(spark):
    src = "/**\n * @swagger\n * /a:\n *   get:\n *     summary: S\n *     parameters:\n *       - name: q\n *         in: query\n *         required: true\n *     responses:\n *       200:\n *         description: Fine\n */\nrouter.get('/a', h)"
    df = spark.createDataFrame([("f", src), ("g", "x\n/** prose */ y\n  " + src + "\n/** @swagger */\n" + src.replace("S\n", "T\n")), ("h", None)], "file string, src string")
    got = sorted((s.file, s.key, s.start_line, s.end_line, s.summary, s.block) for s in swagger_spans(df).collect())
    block = src.split("*/")[0] + "*/"
    assert got == [("f", "GET /a", 1, 13, "S", block), ("g", "GET /a", 18, 30, "T", block.replace("S\n", "T\n"))]
    op = indented_block(src.split("*/")[0] + "*/")["operations"][0]
    assert op["parameters"] == [{"name": "q", "in": "query", "required": True, "type": "string", "description": ""}] and op["responses"] == {"200": "Fine"}


def test_swagger_index_last_wins(spark):
    text = "/**\n * @swagger\n * /a:\n *   get:\n *     summary: {}\n */\n"
    df = spark.createDataFrame([("f", text.format("one") + text.format("two"))], "file string, src string")
    assert [(r.key, r.summary) for r in swagger_index(df).collect()] == [("GET /a", "two")]


@pytest.mark.parametrize(("lines", "target", "want"), [([5, 10, 15], 12, 10), ([5, 20], 15, 5), ([], 2, None), ([3, 20], 20, None), ([20], 20, 20), ([1], 12, None)])
def test_nearest_comment(spark, lines, target, want):
    assert attach(spark, lines, [target]) == [want]


def attach(spark, lines, targets):
    from weftline.operators.joins import asof_attach

    left = spark.createDataFrame([("f", t, k) for k, t in enumerate(targets)], "file string, line int, k int")
    right = spark.createDataFrame([("f", x, k, f"s{k}") for k, x in enumerate(lines)], "file string, at int, ord int, summary string")
    rows = asof_attach(left, right, ["file"], "line", "at", "ord", 10, ["summary"]).collect()
    return [r["at"] for r in sorted(rows, key=lambda r: r.k)]


def brute(lines, target):
    before = [x for x in lines if x < target]
    best = max(before) if before else target if target in lines else None
    return best if best is not None and target - best <= 10 else None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 45), max_size=8), st.lists(st.integers(0, 60), min_size=1, max_size=6))
def test_nearest_comment_like_brute_force(spark, lines, targets):
    assert attach(spark, lines, targets) == [brute(lines, t) for t in targets]


def test_one_comment_serves_two_routes(spark):
    assert attach(spark, [4, 11], [8, 14, 15]) == [4, 11, 11]
