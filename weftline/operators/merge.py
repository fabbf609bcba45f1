"""Set algebra on fields and maps, and merges by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import col, filled


def ordered_union(*arrays) -> Column:
    return F.array_distinct(F.concat(*[col(a) for a in arrays]))


def names_of(params) -> Column:
    return F.transform(F.coalesce(col(params), F.array()), lambda p: p["name"])


def added(generated, original) -> Column:
    return F.array_except(F.coalesce(col(generated), F.array()), F.coalesce(col(original), F.array()))


def right_wins(a, b) -> Column:
    """Map union; independent of the session's key policy."""
    return F.map_concat(F.map_filter(col(a), lambda k, _: ~F.map_contains_key(col(b), k)), col(b))


def left_wins(a, b) -> Column:
    """Map union that only fills gaps."""
    return F.map_concat(col(a), F.map_filter(col(b), lambda k, _: ~F.map_contains_key(col(a), k)))


def first_filled(*values) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[filled(v) for v in values])


def not_empty(array) -> Column:
    return F.when(F.size(col(array)) > 0, col(array))


def merge_endpoints(generated: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """Generated rows with what existing documentation adds to them: seven rules by field, in one left join on the key.

    generated: key, description, security, body, responses map<string,struct<description,schema>>. existing: key, header, query, path (arrays), body,
    responses (as above), tags, description; of rows with one key the last by ``ord`` counts. Rows without a partner pass unchanged.
    """
    from weftline.operators.joins import last_wins

    e = last_wins(existing, [key], ["ord"]).select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in ("header", "query", "path", "body", "responses", "tags", "description")]).alias("e"))
    out = generated.join(e, F.col(key) == F.col("_key"), "left")
    matched = F.col("_key").isNotNull()
    headers = not_empty("e.header")
    nothing = F.coalesce("responses", F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{generated.schema['responses'].dataType.valueType.simpleString()}>>")))
    gaps = F.map_filter(F.col("e.responses"), lambda _, v: v["schema"].isNotNull())
    has_schema = F.coalesce(F.try_element_at(F.col("responses"), F.lit("200"))["schema"].isNotNull(), F.lit(False))
    merged = F.when(matched & ~has_schema & F.col("e.responses").isNotNull(), left_wins(nothing, gaps)).otherwise(F.col("responses"))
    rules = {
        "merged_from_existing": matched,
        "header_parameters": headers,
        "query_parameters": not_empty("e.query"),
        "path_parameters": not_empty("e.path"),
        "existing_tags": not_empty("e.tags"),
        "description": first_filled("description", "e.description"),
        "security": F.coalesce(F.col("security"), F.when(headers.isNotNull(), F.lit("bearerAuth"))),
        "body": F.coalesce(F.col("body"), F.col("e.body")),
        "responses": merged,
    }
    return out.withColumns(rules).drop("_key", "e")


def coverage(merged: DataFrame) -> DataFrame:
    """Counts and whole percentages of merged rows and of those with headers, body and responses."""
    n = F.count("*")

    def share(x):
        return F.coalesce(F.round(100 * x / F.nullif(n, F.lit(0))), F.lit(0.0)).cast("int")

    parts = {"merged": F.count_if("merged_from_existing"), "with_headers": F.count("header_parameters"), "with_body": F.count("body"), "with_responses": F.count_if(F.size("responses") > 0)}
    return merged.agg(n.alias("total"), *[v.alias(k) for k, v in parts.items()], *[share(v).alias(k + "_pct") for k, v in parts.items()])
