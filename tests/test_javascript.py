"""Routes of JavaScript source."""

import pytest

from weftline.functions.javascript import routes_of


def shape(source):
    return [(r["method"], r["path"]) for r in routes_of(source)]


def test_one_route():
    assert shape("router.get('/api/users', function(req,res){})") == [("GET", "/api/users")]
    assert routes_of("router.get('/api/users', function(req,res){})")[0]["framework"] == "express"


def test_all_verbs_and_parameters():
    src = "\n".join(f"router.{m}('/api/users{p}', h);" for m, p in (("get", ""), ("post", ""), ("put", "/:id"), ("delete", "/:id"), ("patch", "/:id")))
    assert shape(src) == [("GET", "/api/users"), ("POST", "/api/users"), ("PUT", "/api/users/:id"), ("DELETE", "/api/users/:id"), ("PATCH", "/api/users/:id")]


def test_templates():
    assert shape("router.get(`${base}/users`, h)") == []
    assert shape("router.get(`/users/${x}`, h)") == [("GET", "/users/")]


@pytest.mark.parametrize(
    ("call", "names"),
    [
        ("router.get('/p', auth, h)", ["auth"]),
        ("router.get('/p', auth, validatePermission, h)", ["auth", "validatePermission"]),
        ("router.get('/p', [auth, validatePermission], h)", ["auth", "validatePermission"]),
        ("router.get('/p', validatePermission([['a', 'b']]), h)", ["validatePermission"]),
        ("router.get('/p', a.b, (x) => x, h)", []),
        ("router.get('/p', h)", []),
    ],
)
def test_middleware(call, names):
    assert routes_of(call)[0]["middleware"] == names


def test_handlers():
    named, inline, none = (routes_of(f"router.get('/p', {h})")[0]["handler"] for h in ("getUsers", "async (req, res, next) => { res.send(1) }", "a.b"))
    assert (named["type"], named["name"]) == ("reference", "getUsers")
    assert inline["type"] == "inline" and len(inline["params"]) == 3 and inline["calls"] == [{"name": "res.send", "line": 1}]
    assert none is None


def test_defaults_of_parameters():
    h = routes_of("router.get('/p', (a, b = 'x', {c} = {}, [d]) => 1)")[0]["handler"]
    assert [(p["name"], p["type"], p["default"]) for p in h["params"]] == [("a", "unknown", None), ("b", "optional", "x"), ("param", "optional", None), ("param", "unknown", None)]


def test_decorators_and_the_prefix_that_carries_on():
    src = "@Controller('/users')\nclass A {\n @Get('/')\n all() {}\n @Post() make() {}\n @Get('/x') prop = 1;\n}\nclass B {\n @Delete('/:id') drop() {}\n}"
    assert shape(src) == [("GET", "/users/"), ("POST", "/users"), ("DELETE", "/users/:id")]
    assert [r["line"] for r in routes_of(src)] == [3, 5, 9]


@pytest.mark.parametrize("src", [None, "", "const x = 1;", "// router.get('/x', h)", "'router.get(\"/x\", h)'", "/router.get('x')/.test(y)", "router.get('/x', h", "router.get('/x', [1, 2))"])
def test_no_routes(src):
    assert routes_of(src) == []


def test_chains_come_outermost_first():
    assert shape("router.get('/a', h).post('/b', h)") == [("POST", "/b"), ("GET", "/a")]


def test_positions_have_three_spellings(spark):
    from weftline.functions.javascript import route_positions

    df = spark.createDataFrame([("f", "\nrouter.get('/api', h)\nrouter.post('a/b', h)\n  router.post('/a/b', g)\n")], "file string, src string")
    found = {p["key"]: (p["line"], p["code"]) for p in route_positions(df).collect()}
    assert found == {**dict.fromkeys(("GET api", "GET /api"), (2, "router.get('/api', h)")), **dict.fromkeys(("POST a/b", "POST /a/b"), (4, "router.post('/a/b', g)"))}


def test_long_chains_take_time_in_proportion():
    import time

    began = time.process_time()
    assert len(routes_of("router" + ".get('/a', h)" * 3000)) == 3000 and len(routes_of("x" + ".y()" * 3000 + ".get('/a', h)" * 1000)) == 1000
    assert time.process_time() - began < 10


def test_tables(spark):
    from weftline.functions.javascript import extract_routes, route_positions

    df = spark.createDataFrame([("a.js", "router.get('/x', auth, h)", 1), ("b.js", None, 2)], "file string, src string, method int")
    assert [(r.file, r.method, r.middleware) for r in extract_routes(df).collect()] == [("a.js", "GET", ["auth"])]
    assert route_positions(df.limit(0)).count() == 0
