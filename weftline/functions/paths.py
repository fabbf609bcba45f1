"""Endpoint ids, keys, path templates, entities, tags and operation ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an operation is called by its method, for summaries and for ids.
SUMMARY_VERBS = {"get": "Get", "post": "Create", "put": "Update", "patch": "Partial update", "delete": "Delete"}
ID_VERBS = {"get": "get", "post": "create", "put": "update", "patch": "updatePartial", "delete": "delete"}
#: Keyword in a path to tags, in order.
TAGS = (
    ("electors", ("Electors", "CRUD")),
    ("users", ("Users", "CRUD")),
    ("auth", ("Authentication", "Auth")),
    ("campaigns", ("Campaigns", "CRUD")),
    ("districts", ("Districts", "CRUD")),
    ("contacts", ("Contacts", "CRUD")),
    ("events", ("Events", "CRUD")),
    ("surveys", ("Surveys", "CRUD")),
    ("reports", ("Reports", "Analytics")),
    ("imports", ("Imports", "Bulk")),
    ("export", ("Exports", "Bulk")),
    ("stats", ("Statistics", "Analytics")),
)
#: Keyword in a path to summary, in order.
SUMMARIES = (
    ("stats", "Get aggregated statistics"),
    ("export", "Export data to format"),
    ("import", "Bulk import records"),
    ("login", "Authenticate user and return JWT"),
    ("register", "Create new user account"),
    ("nearby", "Find nearby entities by location"),
)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_of(*pairs: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def by_value(x: Column, values: dict, otherwise: str) -> Column:
    return first_of(*[(x == k, F.lit(v)) for k, v in values.items()], otherwise=F.lit(otherwise))


def filled(x: str | Column) -> Column:
    """A string, or null if it is empty."""
    return F.nullif(col(x), F.lit(""))


def endpoint_id(method, path) -> Column:
    return F.regexp_replace(F.concat_ws("-", col(method), col(path)), "[^a-zA-Z0-9-]", "-")


def model_id(method, path) -> Column:
    return F.translate(F.concat_ws("_", col(method), F.replace(col(path), F.lit("/"), F.lit("_"))), ":{}", "")


def vector_id(method, path) -> Column:
    return F.concat_ws("-", col(method), F.replace(col(path), F.lit("/"), F.lit("_")))


def endpoint_key(method, path) -> Column:
    return F.concat_ws(" ", F.upper(col(method)), col(path))


def path_template(path, wildcard: bool = True) -> Column:
    """``:name`` to ``{name}`` and, if asked, ``*`` to ``{wildcard}``; no path is ``/``."""
    out = F.regexp_replace(F.coalesce(filled(path), F.lit("/")), ":(\\w+)", "{$1}")
    return F.replace(out, F.lit("*"), F.lit("{wildcard}")) if wildcard else out


def path_without_groups(path) -> Column:
    """A template without numeric groups such as ``(\\d+)``."""
    return F.regexp_replace(path_template(path, wildcard=False), r"\(\\d\+\)", "")


def segments(path) -> Column:
    return F.array_remove(F.split(col(path), "/"), "")


def entity(endpoint, prefix: str = "/api/crm/", lower: bool = True, default: str | None = None) -> Column:
    """The segment after ``prefix``; null, or ``default``, if there is none."""
    found = filled(F.regexp_extract(col(endpoint), prefix + r"([^/\s]+)", 1))
    found = F.lower(found) if lower else found
    return found if default is None else F.coalesce(found, F.lit(default))


def first_tag(path) -> Column:
    """The letters of the first segment that isn't ``api``, or ``default``."""
    parts = segments(path)
    parts = F.when(F.get(parts, F.lit(0)) == "api", F.slice(parts, 2, 1000)).otherwise(parts)
    return F.coalesce(filled(F.regexp_replace(F.get(parts, F.lit(0)), "[^a-zA-Z]", "")), F.lit("default"))


def last_segment(path, default: str) -> Column:
    """The last segment before its first colon; ``default`` if the path has none."""
    parts = segments(path)
    return F.coalesce(filled(F.regexp_replace(F.get(parts, F.size(parts) - 1), "(?s):.*", "")), F.lit(default))


def tags(path) -> Column:
    p = col(path)
    known = [(p.contains(k), F.array(*[F.lit(t) for t in v])) for k, v in TAGS]
    return first_of(*known, otherwise=F.array(last_segment(path, "API"), F.lit("Endpoint")))


def snake_id(method, path) -> Column:
    """``get_api_users_id``; ``get_root`` without segments."""
    name = F.replace(F.array_join(segments(path), "_"), F.lit(":"))
    return F.concat_ws("_", F.lower(col(method)), F.coalesce(filled(name), F.lit("root")))


def camel_id(method, path) -> Column:
    """``createUserGroups`` for POST ``/api/user-groups``."""
    words = F.split(last_segment(path, "item"), "[-_]")
    name = F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")
    return F.concat(by_value(F.lower(col(method)), ID_VERBS, "handle"), name)


def static_summary(method, path) -> Column:
    p = col(path)
    singular = F.coalesce(filled(F.regexp_replace(last_segment(path, "resource"), "s$", "")), F.lit("item"))
    plain = F.concat_ws(" ", by_value(F.lower(col(method)), SUMMARY_VERBS, "Handle"), singular)
    return first_of(*[(p.contains(k), F.lit(v)) for k, v in SUMMARIES], otherwise=plain)


def handler_summary(method, path, handler) -> Column:
    """The older form: the path's keyword, else the handler's name in words, else method and path."""
    p = col(path)
    name = F.trim(F.regexp_replace(col(handler), "([A-Z])", " $1"))
    plain = F.coalesce(filled(name), F.concat_ws(" ", F.upper(col(method)), p))
    return first_of(*[(p.contains(k), F.lit(v)) for k, v in SUMMARIES], otherwise=plain)


def is_auth_route(path) -> Column:
    return col(path).rlike("/login|/register")


def is_route(method, path) -> Column:
    return filled(method).isNotNull() & filled(path).isNotNull()
