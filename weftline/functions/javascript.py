"""Routes of JavaScript source: a small tokenizer, call sites, decorators, and the table function over them.

A source that can't be tokenized or whose brackets don't match gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = frozenset("get post put delete patch head options".split())
DECORATORS = frozenset("Get Post Put Delete Patch Head Options".split())
#: Words after which a slash starts a regular expression, and that are no identifiers.
KEYWORDS = frozenset("await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield null true false".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
TOKEN = re.compile(r"(?P<space>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?)|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'|\"(?:\\[\s\S]|[^\"\\\n])*\")|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[{}()\[\];,.@#])|(?P<operator>[-+*%&|^=!<>?:~]+)")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}

ROUTE_TYPE = (
    "ord int, method string, path string, line int, framework string, middleware array<string>, middlewareLines array<int>, "
    "handler struct<type:string,name:string,line:int,params:array<struct<name:string,type:string,default:string>>,calls:array<struct<name:string,line:int>>>"
)


class Token:
    __slots__ = ("kind", "text", "at", "line", "value", "mate")

    def __init__(self, kind, text, at, line, value=None):
        self.kind, self.text, self.at, self.line, self.value, self.mate = kind, text, at, line, value, -1


def unescaped(text: str) -> str:
    def one(m):
        s = m.group(1)
        if s[0] in "ux":
            return chr(int(s.strip("ux{}"), 16))
        return "" if s in "\n\r\n" else ESCAPES.get(s, s)

    return re.sub(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r\n|[\s\S])", one, text)


def template_end(source: str, at: int) -> tuple[int, int]:
    """The ends of a template's first part and of the template that starts at ``at``."""
    k, first, n = at + 1, -1, len(source)
    while k < n:
        c = source[k]
        if c == "\\":
            k += 2
        elif c == "`":
            return (k if first < 0 else first), k + 1
        elif source.startswith("${", k):
            first = k if first < 0 else first
            depth, k = 1, k + 2
            while k < n and depth:
                c = source[k]
                if c in "'\"":
                    m = TOKEN.match(source, k)
                    if not m or m.lastgroup != "string":
                        raise ValueError("string")
                    k = m.end()
                elif c == "`":
                    k = template_end(source, k)[1]
                else:
                    depth += (c == "{") - (c == "}")
                    k += 1
        else:
            k += 1
    raise ValueError("template")


def tokens_of(source: str) -> list[Token]:
    """Raises ValueError if the text isn't JavaScript as far as tokens and brackets go."""
    out: list[Token] = []
    at, n, line, counted, stack = 0, len(source), 1, 0, []
    while at < n:
        c = source[at]
        kind = value = None
        if c == "`":
            first, end = template_end(source, at)
            kind, value = "template", unescaped(source[at + 1 : first])
        elif c == "/" and not source.startswith(("//", "/*"), at):
            last = out[-1] if out else None
            divides = last and (last.kind in ("number", "string", "template", "regex") or last.kind == "name" and last.text not in KEYWORDS or last.text in (")", "]", "}"))
            m = None if divides else REGEX.match(source, at)
            kind, end = ("regex", m.end()) if m else ("operator", at + 1)
        else:
            m = TOKEN.match(source, at)
            if not m:
                raise ValueError(f"character {c!r}")
            kind, end = m.lastgroup, m.end()
            if kind == "string":
                value = unescaped(m.group()[1:-1])
        if kind != "space":
            line, counted = line + source.count("\n", counted, at), at
            t = Token(kind, source[at:end], at, line, value)
            if t.text in OPEN and kind == "mark":
                stack.append(len(out))
            elif t.text in CLOSE and kind == "mark":
                if not stack or OPEN[out[stack[-1]].text] != t.text:
                    raise ValueError("bracket")
                t.mate = stack.pop()
                out[t.mate].mate = len(out)
            out.append(t)
        at = end
    if stack:
        raise ValueError("bracket")
    return out


def is_name(t: Token) -> bool:
    return t.kind == "name" and t.text not in KEYWORDS


def split_at_commas(tokens: list[Token], a: int, b: int) -> list[tuple[int, int]]:
    """The parts of tokens[a:b] between commas outside brackets."""
    parts, start, k = [], a, a
    while k < b:
        t = tokens[k]
        if t.text in OPEN and t.kind == "mark":
            k = t.mate
        elif t.text == "," and t.kind == "mark":
            parts.append((start, k))
            start = k + 1
        k += 1
    if start < b:
        parts.append((start, b))
    return parts


def expression_start(tokens: list[Token], dot: int, known: dict[int, int]) -> int:
    """The first token of the member chain that ends before tokens[dot]. known: the starts of chains by the dots met before, so a long chain is walked once."""
    k, met = dot - 1, [dot]
    while k >= 0:
        t = tokens[k]
        if t.text in CLOSE and t.kind == "mark":
            k = t.mate
            if t.text in (")", "]") and k > 0 and (tokens[k - 1].kind == "name" and tokens[k - 1].text not in KEYWORDS - {"this", "super"} or tokens[k - 1].text in (")", "]")):
                k -= 1
                continue
        if k > 0 and tokens[k - 1].text in (".", "?."):
            if k - 1 in known:
                k = known[k - 1]
                break
            met.append(k - 1)
            k -= 2
            continue
        break
    known |= dict.fromkeys(met, max(k, 0))
    return max(k, 0)


def call_name(tokens: list[Token], a: int, b: int) -> tuple[str, int] | None:
    """Name and line if tokens[a:b] is a call of a plain name."""
    if b - a >= 3 and is_name(tokens[a]) and tokens[a + 1].text == "(" and tokens[a + 1].mate == b - 1:
        return tokens[a].text, tokens[a].line
    return None


def middleware_of(tokens: list[Token], args: list[tuple[int, int]]) -> list[tuple[str, int]]:
    found = []
    for a, b in args[1:-1] if len(args) >= 3 else []:
        parts = [(a, b)]
        if tokens[a].text == "[" and tokens[a].mate == b - 1:
            parts = split_at_commas(tokens, a + 1, b - 1)
        for x, y in parts:
            if y - x == 1 and is_name(tokens[x]):
                found.append((tokens[x].text, tokens[x].line))
            elif got := call_name(tokens, x, y):
                found.append(got)
    return found


def default_of(tokens: list[Token], a: int, b: int) -> str | None:
    if b - a != 1:
        return None
    t = tokens[a]
    return t.value if t.kind == "string" else t.text if t.kind == "number" or t.text in ("true", "false", "null") else None


def params_of(tokens: list[Token], a: int, b: int) -> list[dict]:
    out = []
    for x, y in split_at_commas(tokens, a, b):
        if y - x == 1 and is_name(tokens[x]):
            out.append({"name": tokens[x].text, "type": "unknown", "default": None})
            continue
        k = x
        while k < y and tokens[k].text != "=":
            k = tokens[k].mate + 1 if tokens[k].text in OPEN and tokens[k].kind == "mark" else k + 1
        if k < y:
            name = tokens[x].text if k - x == 1 and is_name(tokens[x]) else "param"
            out.append({"name": name, "type": "optional", "default": default_of(tokens, k + 1, y)})
        else:
            out.append({"name": "param", "type": "unknown", "default": None})
    return out


def statement_end(tokens: list[Token], start: int, b: int) -> int:
    """The first token behind the statement that starts at ``start``: after a semicolon, a block, or a line end where a new statement can begin."""
    k, header = start, tokens[start].text in ("if", "for", "while", "with")
    while k < b:
        if tokens[k].text in OPEN and tokens[k].kind == "mark":
            k = tokens[k].mate
        last = tokens[k]
        k += 1
        if last.text == ";":
            break
        if header and last.text == ")":  # what follows is the statement's own body
            header = False
            continue
        if k >= b:
            break
        new = tokens[k]
        if last.text == "}" and new.kind != "operator" and new.text not in (".", "?.", ",", "(", ")", "[", ";", "else", "catch", "finally", "while", "=>"):
            break
        ends = last.kind in ("number", "string", "template", "regex") or last.kind == "name" and (last.text not in KEYWORDS or last.text in ("this", "true", "false", "null", "return", "break", "continue")) or last.text in (")", "]", "}")
        starts = new.kind in ("string", "number") or new.kind == "name" and new.text not in ("in", "instanceof") or new.text in ("{", "@")
        if new.line > last.line and ends and starts:
            break
    return k


def calls_of(tokens: list[Token], a: int, b: int) -> list[dict]:
    """Calls of names, or of a name's member, that are statements of the block tokens[a:b] themselves."""
    out, start = [], a
    while start < b:
        end = statement_end(tokens, start, b)
        k, last = start + (tokens[start].text == "await"), end - (tokens[end - 1].text == ";")
        name, p = None, -1
        if k + 1 < last and is_name(tokens[k]) and tokens[k + 1].text == "(":
            name, p = tokens[k].text, k + 1
        elif k + 3 < last and is_name(tokens[k]) and tokens[k + 1].text == "." and tokens[k + 2].kind == "name" and tokens[k + 3].text == "(":
            name, p = f"{tokens[k].text}.{tokens[k + 2].text}", k + 3
        if name and tokens[p].mate == last - 1:
            out.append({"name": name, "line": tokens[k].line})
        start = end
    return out


def handler_of(tokens: list[Token], a: int, b: int) -> dict | None:
    line = tokens[a].line
    if b - a == 1 and is_name(tokens[a]):
        return {"type": "reference", "name": tokens[a].text, "line": line, "params": None, "calls": None}
    k = a + 1 if tokens[a].text == "async" and b - a > 1 else a
    params, body, plain = None, None, tokens[k].text == "function"
    if plain:
        k += 1
        while k < b and tokens[k].text != "(":
            k += 1
        if k >= b or tokens[k].mate + 1 >= b or tokens[tokens[k].mate + 1].text != "{":
            return None
        params, body = params_of(tokens, k + 1, tokens[k].mate), tokens[k].mate + 1
    elif tokens[k].text == "(" and tokens[k].mate + 1 < b and tokens[tokens[k].mate + 1].text == "=>":
        params, body = params_of(tokens, k + 1, tokens[k].mate), tokens[k].mate + 2
    elif k + 1 < b and is_name(tokens[k]) and tokens[k + 1].text == "=>":
        params, body = params_of(tokens, k, k + 1), k + 2
    if params is None:
        return None
    block = body < b and tokens[body].text == "{" and tokens[body].mate == b - 1
    if plain and not block:
        return None
    return {"type": "inline", "name": "anonymous", "line": line, "params": params, "calls": calls_of(tokens, body + 1, b - 1) if block else []}


def call_routes(tokens: list[Token]) -> list[dict]:
    """Routes by calls such as ``x.get('/path', ..., handler)``, in the order of a syntax tree: outer calls before what they contain."""
    found, known = [], {}
    for k, t in enumerate(tokens):
        if t.kind != "name" or t.text.lower() not in METHODS or k == 0 or k + 1 >= len(tokens):
            continue
        computed = tokens[k - 1].text == "[" and tokens[k + 1].text == "]" and k + 2 < len(tokens)
        paren = k + 2 if computed else k + 1
        if tokens[paren].text != "(" or tokens[k - 1].text != "." and not computed:
            continue
        start, end = expression_start(tokens, k - 1, known), tokens[paren].mate
        args = split_at_commas(tokens, paren + 1, end)
        path = "/"
        if args:
            a, b = args[0]
            path = tokens[a].value if b - a == 1 and tokens[a].kind in ("string", "template") else None
        if not path:
            continue
        middleware = middleware_of(tokens, args)
        found.append((tokens[start].at, -end, {"method": t.text.upper(), "path": path, "line": tokens[start].line, "middleware": [m for m, _ in middleware], "middlewareLines": [n for _, n in middleware], "handler": handler_of(tokens, *args[-1]) if args else None}))
    return [x for _, _, x in sorted(found, key=lambda x: x[:2])]


def decorator_routes(tokens: list[Token]) -> list[dict]:
    """Routes by decorators of methods; the last controller's prefix holds until the next one."""
    out, prefix, k = [], "", 0
    while k < len(tokens):
        if tokens[k].text != "@" or tokens[k].kind != "mark":
            k += 1
            continue
        line, marks = tokens[k].line, []
        while k < len(tokens) and tokens[k].text == "@":
            name = tokens[k + 1].text if k + 1 < len(tokens) else ""
            k += 2
            while k + 1 < len(tokens) and tokens[k].text == ".":
                name, k = "", k + 2
            value = None
            if k < len(tokens) and tokens[k].text == "(":
                args = split_at_commas(tokens, k + 1, tokens[k].mate)
                value = tokens[args[0][0]].value if args and args[0][1] - args[0][0] == 1 and tokens[args[0][0]].kind == "string" else ""
                has, k = bool(args), tokens[k].mate + 1
                marks.append((name, value, has))
        while k < len(tokens) and tokens[k].text in ("export", "default", "abstract", "public", "private", "protected", "static", "async", "get", "set", "*") and k + 1 < len(tokens) and tokens[k + 1].text != "(":
            k += 1
        if k < len(tokens) and tokens[k].text == "class":
            for name, value, has in marks:
                if name == "Controller" and has and value:
                    prefix = value
        elif k + 1 < len(tokens) and (tokens[k].kind in ("name", "string", "number") and tokens[k + 1].text == "(" or tokens[k].text == "[" and tokens[k].mate + 1 < len(tokens) and tokens[tokens[k].mate + 1].text == "("):
            method = tokens[k].text if tokens[k].kind == "name" else "anonymous"
            for name, value, _ in marks:
                if name in DECORATORS:
                    out.append({"method": name.upper(), "path": prefix + (value or ""), "line": line, "middleware": [], "middlewareLines": [], "handler": {"type": "method", "name": method, "line": line, "params": None, "calls": None}})
    return out


def framework_of(source: str) -> str:
    for name, words in (("express", ("express.Router", "router.get", "router.post")), ("nestjs", ("@Controller", "@Get(", "@Post(")), ("fastify", ("fastify.get", "fastify.post")), ("koa", ("koa-router", "Router"))):
        if any(w in source for w in words):
            return name
    return "express"


def routes_of(source: str | None) -> list[dict]:
    """All routes of a source, calls first, then decorators."""
    if not source:
        return []
    try:
        tokens = tokens_of(source)
    except ValueError:
        return []
    framework = framework_of(source)
    found = [{**r, "framework": framework} for r in call_routes(tokens)] + [{**r, "framework": "nestjs"} for r in decorator_routes(tokens)]
    return [{"ord": k, **r} for k, r in enumerate(found)]


def extract_routes(sources: DataFrame, file: str = "file", src: str = "src") -> DataFrame:
    """``sources(file, src)`` to one row for each route: file and ROUTE_TYPE. Only these two columns are read."""
    sources = sources.select(F.col(file).alias("file"), F.col(src).alias("src"))

    def run(batches):
        import pyarrow as pa

        call = pa.struct([("name", pa.string()), ("line", pa.int32())])
        param = pa.struct([("name", pa.string()), ("type", pa.string()), ("default", pa.string())])
        handler = pa.struct([("type", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("params", pa.list_(param)), ("calls", pa.list_(call))])
        schema = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("method", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("framework", pa.string()), ("middleware", pa.list_(pa.string())), ("middlewareLines", pa.list_(pa.int32())), ("handler", handler)])
        for b in batches:
            rows = [{"file": f, **r} for f, s in zip(b.column("file").to_pylist(), b.column("src").to_pylist()) for r in routes_of(s)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.mapInArrow(run, "file string, " + ROUTE_TYPE)


def route_positions(sources: DataFrame, file: str = "file", src: str = "src") -> DataFrame:
    """file, key, line and code of each route that a call defines, under three spellings of its path: as it stands, with a slash before, and without. The route of
    the last line wins a key. Positions come from the same tokens as the routes."""
    routes = extract_routes(sources, file, src).where("framework <> 'nestjs' or handler.type <> 'method' or handler is null")
    lines = sources.select(F.col(file).alias("f"), F.split(F.coalesce(F.col(src), F.lit("")), "\n").alias("lines"))
    at = routes.join(lines, F.col("file") == F.col("f")).select("file", "ord", "method", "path", "line", F.trim(F.get("lines", F.col("line") - 1)).alias("code"))
    plain = F.regexp_replace("path", "^/+", "")
    spelled = at.select("*", F.explode(F.array_distinct(F.array(F.col("path"), F.concat(F.lit("/"), plain), plain))).alias("spelling"))
    last = F.max_by(F.struct("line", "code"), F.struct("line", "ord")).alias("at")
    return spelled.groupBy("file", F.concat_ws(" ", "method", "spelling").alias("key")).agg(last).select("file", "key", "at.line", "at.code")
