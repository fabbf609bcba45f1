"""What regular expressions find in source text: dependencies, parameters, body fields, handler slices, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.paths import col, filled, first_of

#: Receivers that are no tables.
NO_TABLES = ("req", "res", "next", "console", "async", "await")
TABLE_CALLS = ("find", "findOne", "create", "update", "destroy")
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
#: Patterns of what counts as a dependency, a field or a definition.
MODEL_NAME = r"""mongoose\.model\(['"](\w+)['"]\)"""
SERVICE_CALL = r"(\w+Service)\.\w+\("
AXIOS_CALL = r"""axios\.(get|post|put|delete|patch)\(['"`]([^'"`]+)"""
FETCH_CALL = r"""fetch\(['"`]([^'"`]+)"""
DESTRUCTURED = r"const\s*\{\s*([^}]+)\s*\}\s*=\s*req\."
BODY_ALIAS = r"const\s+(\w+)\s*=\s*req\.body"
JSON_ANSWER, ANSWER_KEY = r"res\.json\(\{([^}]+)\}", r"(\w+):"
API_PARAM = r"(?m)@apiParam\s+\{(\w+)\}\s+(\w+)\s+(.+)$"
WHITE = " \t\n\r\f\x0b"


def trimmed(x) -> Column:
    return F.btrim(col(x), F.lit(WHITE))


def all_of(text, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), group)


def line_of(text, position) -> Column:
    """The line, from 1, of a position, from 1."""
    before = F.substring(col(text), F.lit(1), col(position) - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def framework(source) -> Column:
    s = F.coalesce(col(source), F.lit(""))

    def has(*words):
        out = s.contains(words[0])
        for w in words[1:]:
            out = out | s.contains(w)
        return out

    return first_of((has("express.Router", "router.get", "router.post"), F.lit("express")), (has("@Controller", "@Get(", "@Post("), F.lit("nestjs")), (has("fastify.get", "fastify.post"), F.lit("fastify")), (has("koa-router", "Router"), F.lit("koa")), otherwise=F.lit("express"))


def database_calls(source) -> Column:
    """Distinct receivers of table calls and names of models, by pattern, then place."""
    found = [all_of(source, rf"(\w+)\.{call}\(") for call in TABLE_CALLS] + [all_of(source, MODEL_NAME)]
    return F.array_except(F.flatten(F.array(*found)), F.array(*[F.lit(x) for x in NO_TABLES]))


def service_calls(source) -> Column:
    return F.array_distinct(all_of(source, SERVICE_CALL))


def http_calls(source) -> Column:
    """url and method of each outgoing call; a plain fetch counts as GET."""
    verbs = F.transform(F.arrays_zip(all_of(source, AXIOS_CALL, 2).alias("url"), all_of(source, AXIOS_CALL, 1).alias("method")), lambda x: F.struct(x["url"].alias("url"), F.upper(x["method"]).alias("method")))
    plain = F.transform(all_of(source, FETCH_CALL), lambda x: F.struct(x.alias("url"), F.lit("GET").alias("method")))
    return F.concat(verbs, plain)


def fields_of(source, kind: str) -> Column:
    """The fields of the first ``const {a, b} = req.<kind>``."""
    inside = F.regexp_extract(F.coalesce(col(source), F.lit("")), DESTRUCTURED + kind, 1)
    return F.filter(F.transform(F.split(inside, ","), trimmed), lambda x: x != "")


def query_fields(source) -> Column:
    named = F.transform(fields_of(source, "query"), lambda x: trimmed(F.split(x, "=")[0]))
    return F.array_distinct(F.concat(all_of(source, r"req\.query\.(\w+)"), F.filter(named, lambda x: x != "")))


def body_fields(source) -> Column:
    return F.array_distinct(F.concat(all_of(source, r"req\.body\.(\w+)"), fields_of(source, "body"), all_of(source, BODY_ALIAS)))


def body_required(source) -> Column:
    """Destructured fields that aren't read by name elsewhere."""
    return F.array_except(fields_of(source, "body"), all_of(source, r"req\.body\.(\w+)"))


def body_schema(source) -> Column:
    """type, properties and required of the request body, or null if no field is found."""
    fields = body_fields(source)
    properties = F.map_from_entries(F.transform(fields, lambda x: F.struct(x.alias("key"), F.struct(F.lit("string").alias("type")).alias("value"))))
    required = body_required(source)
    return F.when(F.size(fields) > 0, F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.when(F.size(required) > 0, required).alias("required")))


def output_fields(source) -> Column:
    inside = all_of(source, JSON_ANSWER)
    return F.array_distinct(F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(ANSWER_KEY), 1))))


def path_fields(path) -> Column:
    return all_of(path, r":([a-zA-Z0-9_]+)")


def present_in(fields, code) -> Column:
    """The fields that the code contains; none without code."""
    return F.when(filled(code).isNotNull(), F.filter(col(fields), lambda x: F.contains(col(code), x))).otherwise(F.array().cast("array<string>"))


def header_parameters(middleware) -> Column:
    """An Authorization header if a middleware's name speaks of authentication."""
    header = F.struct(F.lit("Authorization").alias("name"), F.lit("header").alias("in"), F.lit(True).alias("required"), F.lit("string").alias("type"), F.lit("Authorization: token returned from user/signin").alias("description"))
    return F.when(F.exists(col(middleware), lambda x: x.rlike("auth|Auth|verifyToken")), F.array(header)).otherwise(F.array().cast("array<struct<name:string,in:string,required:boolean,type:string,description:string>>"))


def handler_code(source, method, path, most: int = 2500, before: int = 400, skip: int = 100) -> Column:
    """The code around a route's definition, up to the next one; the source's start if the definition isn't found.

    The path is matched literally.
    """
    s, p = F.coalesce(col(source), F.lit("")), F.regexp_replace(col(path), "^/", "")
    quoted = F.concat(F.lit("""\\s*\\(\\s*['"`]/?\\Q"""), p, F.lit("""\\E['"`]"""))
    exact = F.regexp_instr(s, F.concat(F.lit("router\\."), F.lower(col(method)), quoted))
    loose = F.regexp_instr(s, F.concat(F.lit("router\\.(?:get|post|put|patch|delete|options)"), quoted))
    at = F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(loose, F.lit(0)))
    start = F.greatest(F.lit(1), at - before)
    following = F.regexp_instr(F.substring(s, at + skip, F.lit(1_000_000_000)), F.lit("\\n(?:router|module\\.exports)"))
    end = F.when((following > 0) & (following <= most), at + skip + following - 1).otherwise(at + most)
    return F.when(at.isNull() | (p == ""), F.substring(s, F.lit(1), F.lit(most))).otherwise(F.substring(s, start, end - start))


def apidoc(block) -> Column:
    """description and params of an ``@apiDescription`` block."""
    text = F.regexp_extract(col(block), r"(?s)@apiDescription\s+(.+?)(?=\n\s*\*|\n\*/|\z)", 1)
    params = F.arrays_zip(all_of(block, API_PARAM, 1).alias("type"), all_of(block, API_PARAM, 2).alias("name"), all_of(block, API_PARAM, 3).alias("desc"))
    return F.struct(filled(trimmed(F.regexp_replace(text, r"\n\s*\*\s*", " "))).alias("description"), params.alias("params"))


def schema_type(text) -> Column:
    """The first type that the text names, else string."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return first_of(*[(low.contains(t), F.lit(t)) for t in ("string", "number", "integer", "boolean", "array", "object")], otherwise=F.lit("string"))


def example_value(field) -> Column:
    """A JSON literal that suits the field's name."""
    low = F.lower(col(field))
    rules = (("name", '"John Doe"'), ("email", '"john@example.com"'), ("phone", '"+1-555-0123"'), ("age", "25"), ("id", '"507f1f77bcf86cd799439011"'), ("date", '"2024-01-15"'), ("count", "0"), ("enabled", "true"), ("active", "true"))
    return first_of(*[(low.contains(k), F.lit(v)) for k, v in rules], otherwise=F.lit('"sample_value"'))


def links(html) -> Column:
    return all_of(html, '<a href="([^"]+)"')


def comment_blocks(text, pattern: str = r"/\*\*([\s\S]*?)\*/") -> Column:
    return all_of(text, pattern)


def repaired_json(text) -> Column:
    """The text as JSON, else what lies between its first and last brace, else null."""
    return F.coalesce(F.try_parse_json(col(text)), F.try_parse_json(F.regexp_extract(col(text), r"\{[\s\S]*\}", 0)))


def numbered(text, mark: str) -> Column:
    """Each line with the mark and its number, from 1."""
    return F.array_join(F.transform(F.split(col(text), "\n"), lambda x, i: F.concat(F.lit(mark + " "), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def rubric(response) -> Column:
    """The score of a model's answer."""
    low, raw = F.lower(col(response)), col(response)
    checks = ((0.25, low.contains("get") & raw.contains("/api/users")), (0.25, low.contains("post") & raw.contains("/api/users")), (0.25, low.contains("get") & raw.contains(":id")), (0.15, low.contains("auth") | low.contains("middleware")), (0.10, low.contains("summary") | low.contains("description")))
    return sum(F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for v, c in checks)
