"""Comparison of generated with original documentation, patches, and their reports.

generated: method, path, summary, description, params array<string>, body array<string>, responses array<string>, tags array<string>. original: the same
fields for what is documented. Keys are made alike on both sides (``:id`` as ``{id}``), so each comparison is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import col, endpoint_key, path_template
from weftline.functions.source_text import numbered
from weftline.operators.merge import added

#: Fixed format of a generated comment block: path, method, summary, description, tag.
BLOCK = "/**\n * @swagger\n * %s:\n *   %s:\n *     summary: %s\n *     description: %s\n *     tags:\n *       - %s\n *     parameters: []\n *     responses:\n *       200:\n *         description: Success\n *       401:\n *         description: Unauthorized\n *       500:\n *         description: Server Error\n */"
#: How much longer a summary and a description must be to count as better.
LONGER_SUMMARY, LONGER_TEXT = 15, 20


def key_of(method, path) -> Column:
    """One key for all spellings of a route: upper-case method, leading slash, parameters in braces."""
    return endpoint_key(method, F.concat(F.lit("/"), F.regexp_replace(path_template(path), "^/", "")))


def longer(a, b, by: int) -> Column:
    return F.length(F.coalesce(col(a), F.lit(""))) > F.length(F.coalesce(col(b), F.lit(""))) + by


def compare_docs(generated: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each generated operation: state (improved, unchanged, new), what was added and removed, and what got better."""
    g = generated.withColumn("_k", key_of("method", "path"))
    o = original.withColumn("_ko", key_of("method", "path")).groupBy("_ko").agg(F.max_by(F.struct("summary", "description", "params", "body", "responses"), "ord").alias("o"))
    x = g.join(o, F.col("_k") == F.col("_ko"), "left")
    has = F.col("_ko").isNotNull()

    def more(field):
        return has & (F.size(F.coalesce(field, F.array())) > F.size(F.coalesce(f"o.{field}", F.array())))

    text = has & (longer("summary", "o.summary", LONGER_SUMMARY) | longer("description", "o.description", LONGER_TEXT))
    better = text | more("params") | more("body") | more("responses")
    return x.select(
        F.upper("method").alias("method"), "path", "summary", F.col("o.summary").alias("original_summary"),
        F.when(~has, "new").when(better, "improved").otherwise("unchanged").alias("state"),
        added("params", "o.params").alias("params_added"), F.when(has, added("o.params", "params")).otherwise(F.array().cast("array<string>")).alias("params_removed"),
        added("body", "o.body").alias("body_added"), added("responses", "o.responses").alias("responses_added"),
        (more("params") | has & (F.size(added("params", "o.params")) > 0)).alias("params_improved"), more("body").alias("schema_improved"),
        (more("responses") | has & (F.size(added("responses", "o.responses")) > 0)).alias("responses_improved"),
    )


#: The counters of a comparison: name, and the rows that count.
COUNTERS = {"total": None, "with_original": "state <> 'new'", "improved": "state = 'improved'", "unchanged": "state = 'unchanged'", "new": "state = 'new'", "params_improved": "params_improved", "schema_improved": "schema_improved", "responses_improved": "responses_improved"}


def _counters() -> list[Column]:
    return [(F.count("*") if rows is None else F.count_if(F.expr(rows))).alias(name) for name, rows in COUNTERS.items()]


def comparison_counts(compared: DataFrame) -> DataFrame:
    """The seven counters in one pass; new routes are what total and with_original leave."""
    return compared.agg(*_counters()).drop("new")


def markdown_report(compared: DataFrame) -> DataFrame:
    """One row, report: a table of the counters, and the routes by state, improved ones with what was added and what stood before. The text is as long as the
    report, so it is meant for one project's routes."""
    def listed(name, column):
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{name}: "), F.array_join(column, ", ")))

    reasons = F.concat_ws("; ", F.when(F.coalesce("original_summary", F.lit("")) != "", F.concat(F.lit("was: "), "original_summary")), listed("parameters", F.col("params_added")), listed("body", F.col("body_added")), listed("responses", F.col("responses_added")))
    line = F.concat(F.format_string("- `%s %s` %s", "method", "path", F.coalesce("summary", F.lit(""))), F.when((F.col("state") == "improved") & (reasons != ""), F.concat(F.lit(" ("), reasons, F.lit(")"))).otherwise(""))
    states = ("improved", "new", "unchanged")
    one = compared.agg(*_counters(), *[F.array_sort(F.collect_list(F.when(F.col("state") == state, line))).alias(f"{state}_lines") for state in states])
    table = ["| Figure | Value |", "|-|-|", *[F.format_string(f"| {name.replace('_', ' ')} | %d |", name) for name in COUNTERS]]
    sections = [F.when(F.size(f"{state}_lines") > 0, F.concat(F.format_string(f"\n## {state.capitalize()} (%d)\n\n", state), F.array_join(f"{state}_lines", "\n"))) for state in states]
    return one.select(F.concat_ws("\n", F.lit("# Documentation comparison\n"), *[F.lit(x) if isinstance(x, str) else x for x in table], *sections).alias("report"))


def doc_block(method, path, summary, description, tag) -> Column:
    """The comment block of an operation."""

    def text(x, default):
        return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(default))

    return F.format_string(BLOCK, col(path), F.lower(col(method)), text(summary, "TODO: Add summary"), text(description, "TODO: Add description"), text(tag, "API"))


def patches(generated: DataFrame, spans: DataFrame, routes: DataFrame, positions: DataFrame) -> DataFrame:
    """Replacements of blocks whose summary has become longer by more than 15 characters, and insertions before routes without a block.

    spans: file, key parts (method, path), start_line, end_line, block, summary. routes: file, method, path, line, ord. positions: file, key, line as a
    fallback. A route without a known source file gives no patch.
    """
    g = generated.withColumn("_k", key_of("method", "path"))
    r = routes.withColumn("_kr", key_of("method", "path")).groupBy("_kr").agg(F.min_by(F.struct("file", "line"), F.struct("file", "ord")).alias("r"))
    s = spans.withColumn("_ks", key_of("method", "path")).groupBy("file", "_ks").agg(F.max_by(F.struct("start_line", "end_line", "block", "summary"), "start_line").alias("s")).withColumnRenamed("file", "_fs")
    p = positions.withColumn("_kp", key_of(F.split("key", " ")[0], F.regexp_extract("key", r"^\S+ (.*)$", 1))).groupBy("file", "_kp").agg(F.max("line").alias("_line")).withColumnRenamed("file", "_fp")
    x = g.join(r, F.col("_k") == F.col("_kr")).join(s, (F.col("_k") == F.col("_ks")) & (F.col("r.file") == F.col("_fs")), "left").join(p, (F.col("_k") == F.col("_kp")) & (F.col("r.file") == F.col("_fp")), "left")
    old = F.col("_ks").isNotNull()
    x = x.where(~old | longer("summary", "s.summary", LONGER_SUMMARY)).withColumn("new_content", doc_block("method", "path", "summary", "description", F.get("tags", F.lit(0))))
    at = F.coalesce(F.when(F.col("r.line") > 0, F.col("r.line")), F.col("_line"), F.lit(1))
    return x.select(
        F.when(old, "improved").otherwise("new").alias("type"), F.upper("method").alias("method"), "path", F.when(old, "replace").otherwise("insert").alias("action"), F.col("r.file").alias("file"),
        F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), F.when(~old, at).alias("insert_before_line"), F.col("s.block").alias("original_content"), "new_content",
        F.when(old, numbered("s.block", "-")).otherwise("").alias("diff_old"), numbered("new_content", "+").alias("diff_new"),
    )


def diffs_by_file(found: DataFrame) -> DataFrame:
    """file and diff: the patches of each file, in the order of their lines."""
    head = F.format_string("@@ %s %s (%s)", "method", "path", "action")
    body = F.concat_ws("\n", head, F.nullif("diff_old", F.lit("")), "diff_new")
    one = F.struct(F.coalesce("start_line", "insert_before_line").alias("line"), F.col("method"), F.col("path"), body.alias("body"))
    return found.groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("x")).select("file", F.array_join(F.transform("x", lambda v: v["body"]), "\n\n").alias("diff"))


def missing_information(generated: DataFrame, original: DataFrame) -> DataFrame:
    """Six counts of what originals have and generated operations lack.

    both: entity, method, path, n_params, has_body, has_detail, has_examples.
    """
    columns = ("n_params", "has_body", "has_detail", "has_examples")
    g = generated.select("entity", key_of("method", "path").alias("key"), F.struct(*columns).alias("g"))
    o = original.select("entity", key_of("method", "path").alias("key"), F.struct(*columns).alias("o"))
    x = g.join(o, ["entity", "key"], "full")
    both = F.col("g").isNotNull() & F.col("o").isNotNull()
    return x.agg(
        F.count("g").alias("total"), F.count_if(both).alias("compared"), F.count_if(F.col("o").isNull()).alias("missing_in_original"), F.count_if(F.col("g").isNull()).alias("missing_in_generated"),
        F.count_if(both & (F.col("o.n_params") > 0) & (F.col("g.n_params") == 0)).alias("missing_parameters"), F.count_if(both & F.col("o.has_body") & ~F.col("g.has_body")).alias("missing_body"),
        F.count_if(both & F.col("o.has_detail") & ~F.col("g.has_detail")).alias("missing_response_details"), F.count_if(both & F.col("o.has_examples") & ~F.col("g.has_examples")).alias("missing_examples"),
    )


def matched_originals(generated: DataFrame, original: DataFrame, prefix: str = "/api/crm/") -> DataFrame:
    """Generated operations (entity, method, path, ...) with the original of their entity that fits best, as the struct original, or null.

    The same route counts first, then the route without ``prefix``, then the first original of the entity by ord that has the method. Each way is an equi-join on a
    side of one row for each key.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in original.columns])
    o = original.select("entity", key_of("method", "path").alias("key"), F.upper("method").alias("verb"), "ord", rest.alias("row"))
    by_key = o.groupBy("entity", "key").agg(F.min_by("row", "ord").alias("row"))
    by_verb = o.groupBy("entity", "verb").agg(F.min_by("row", "ord").alias("row"))
    short = F.regexp_replace(F.col("path"), f"^{prefix}", "/")
    x = generated.withColumns({"_k": key_of("method", "path"), "_s": key_of("method", short), "_v": F.upper("method")})
    for name, side, own, their in (("_1", by_key, "_k", "key"), ("_2", by_key, "_s", "key"), ("_3", by_verb, "_v", "verb")):
        y = side.select(F.col("entity").alias(name + "e"), F.col(their).alias(name + "k"), F.col("row").alias(name))
        x = x.join(y, F.col("entity").eqNullSafe(F.col(name + "e")) & (F.col(own) == F.col(name + "k")), "left").drop(name + "e", name + "k")
    return x.withColumn("original", F.coalesce("_1", "_2", "_3")).drop("_1", "_2", "_3", "_k", "_s", "_v")


def missing_lists(generated: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each thing that a generated operation lacks: category, entity, method, path. original: as in ``missing_information``, with ord."""
    x = matched_originals(generated, original)
    both = F.col("original").isNotNull()
    found = {
        "missing_in_original": ~both,
        "missing_parameters": both & (F.col("original.n_params") > 0) & (F.col("n_params") == 0),
        "missing_body": both & F.col("original.has_body") & ~F.col("has_body"),
        "missing_response_details": both & F.col("original.has_detail") & ~F.col("has_detail"),
        "missing_examples": both & F.col("original.has_examples") & ~F.col("has_examples"),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in found.items()]))
    return x.select(F.explode(named).alias("category"), "entity", F.upper("method").alias("method"), "path")


def validated(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches that name a type, a file and new content, and those whose file isn't listed (warnings)."""
    good = found.where("type in ('new', 'improved') and file is not null and new_content <> ''")
    return good, good.join(files.select("file").distinct(), "file", "left_anti")


def request_text(found: DataFrame) -> DataFrame:
    """One row, text: the description of a change request with counts and a line for each patch."""
    line = F.format_string("- %s `%s %s` in %s", "type", "method", "path", "file")
    rows = found.agg(F.count_if(F.col("type") == "new").alias("n"), F.count_if(F.col("type") == "improved").alias("i"), F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(F.concat_ws("\n", F.lit("## Documentation"), F.format_string("New: %d, improved: %d", "n", "i"), F.array_join("lines", "\n")).alias("text"))
