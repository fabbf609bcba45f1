"""The registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import comments, openapi, paths, source_text
from weftline.functions.javascript import route_positions
from weftline.operators import aggregates, compare, evaluate, joins, merge, vectors, windows
from weftline.plans import fixtures, project

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- extraction -------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, (i - 1)::INT AS pos, l[i] AS link FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS l FROM pages), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)""")
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(source_text.links("html")).alias("pos", "link"))


@query("""SELECT page_id, (i - 1)::INT AS ord, trim(l[i]) AS block FROM (SELECT page_id, regexp_extract_all(html, '<!--([\\s\\S]*?)-->', 1) AS l FROM pages), LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)""".replace("\\\\", "\\"))
def comment_blocks(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(source_text.comment_blocks("html", r"<!--([\s\S]*?)-->")).alias("ord", "block"))
    return found.select("page_id", "ord", F.trim("block").alias("block"))


@query("""SELECT entity, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(regexp_extract(unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)), '/([^/?#]+)', 1)) AS entity FROM pages) WHERE entity <> '' GROUP BY entity""")
def entity_counts(spark, sf_dir):
    """Flagship: references of every page, counted by entity."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(source_text.links("html")).alias("link")).select("page_id", F.lower(F.regexp_extract("link", "/([^/?#]+)", 1)).alias("entity"))
    return found.where("entity <> ''").groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query(r"""SELECT call, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(html, '(\w+)\(', 1))) AS call FROM pages) GROUP BY call""")
def script_calls(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.explode(F.array_distinct(source_text.all_of("html", r"(\w+)\("))).alias("call"))
    return found.groupBy("call").agg(F.count("*").alias("n"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(source_text.repaired_json("props"), "$.k", "int").alias("k"))


@query("""SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, string_split(text, chr(10))[1] AS first_line, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '+ ' || i || ': ' || x), chr(10))) AS numbered FROM documents""")
def line_split(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), lines[0].alias("first_line"), F.md5(source_text.numbered("text", "+")).alias("numbered"))


# --- projections ------------------------------------------------------------------------------------------------------

URL_PATH = r"^https?://[^/]+(/[^?#]*)"


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/(\d+)', '/{id}', 'g') AS template, regexp_replace('GET-' || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[^a-zA-Z0-9-]', '-', 'g') AS id, 'GET ' || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS key FROM pages""")
def path_template(spark, sf_dir):
    path = F.regexp_extract("url", URL_PATH, 1)
    named = F.regexp_replace(path, r"/(\d+)", "/:id")
    return table(spark, sf_dir, "pages").select("page_id", paths.path_template(named).alias("template"), paths.endpoint_id(F.lit("GET"), path).alias("id"), paths.endpoint_key(F.lit("get"), path).alias("key"))


@query(r"""SELECT page_id,
  CASE WHEN u LIKE '%electors%' THEN 'Electors,CRUD' WHEN u LIKE '%users%' THEN 'Users,CRUD' WHEN u LIKE '%auth%' THEN 'Authentication,Auth' WHEN u LIKE '%campaigns%' THEN 'Campaigns,CRUD' WHEN u LIKE '%districts%' THEN 'Districts,CRUD' WHEN u LIKE '%contacts%' THEN 'Contacts,CRUD' WHEN u LIKE '%events%' THEN 'Events,CRUD' WHEN u LIKE '%surveys%' THEN 'Surveys,CRUD' WHEN u LIKE '%reports%' THEN 'Reports,Analytics' WHEN u LIKE '%imports%' THEN 'Imports,Bulk' WHEN u LIKE '%export%' THEN 'Exports,Bulk' WHEN u LIKE '%stats%' THEN 'Statistics,Analytics' ELSE last || ',Endpoint' END AS tags,
  CASE WHEN u LIKE '%stats%' THEN 'Get aggregated statistics' WHEN u LIKE '%export%' THEN 'Export data to format' WHEN u LIKE '%import%' THEN 'Bulk import records' WHEN u LIKE '%login%' THEN 'Authenticate user and return JWT' WHEN u LIKE '%register%' THEN 'Create new user account' WHEN u LIKE '%nearby%' THEN 'Find nearby entities by location' ELSE 'Get ' || coalesce(nullif(regexp_replace(last, 's$', ''), ''), 'item') END AS summary,
  CASE WHEN h LIKE '%string%' THEN 'string' WHEN h LIKE '%number%' THEN 'number' WHEN h LIKE '%integer%' THEN 'integer' WHEN h LIKE '%boolean%' THEN 'boolean' WHEN h LIKE '%array%' THEN 'array' WHEN h LIKE '%object%' THEN 'object' ELSE 'string' END AS schema_type,
  CASE WHEN html LIKE '%express.Router%' OR html LIKE '%router.get%' OR html LIKE '%router.post%' THEN 'express' WHEN html LIKE '%@Controller%' OR html LIKE '%@Get(%' OR html LIKE '%@Post(%' THEN 'nestjs' WHEN html LIKE '%fastify.get%' OR html LIKE '%fastify.post%' THEN 'fastify' WHEN html LIKE '%koa-router%' OR html LIKE '%Router%' THEN 'koa' ELSE 'express' END AS framework
FROM (SELECT page_id, url AS u, lower(html) AS h, html, coalesce(nullif(regexp_replace(list_filter(string_split(url, '/'), lambda x: x <> '')[-1], ':.*', ''), ''), 'API') AS last FROM pages)""")
def classify_case(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(paths.tags("url"), ",").alias("tags"), paths.static_summary(F.lit("GET"), "url").alias("summary"), source_text.schema_type("html").alias("schema_type"), source_text.framework("html").alias("framework"))


@query(r"""SELECT source, CASE WHEN s LIKE '%name%' THEN '"John Doe"' WHEN s LIKE '%email%' THEN '"john@example.com"' WHEN s LIKE '%phone%' THEN '"+1-555-0123"' WHEN s LIKE '%age%' THEN '25' WHEN s LIKE '%id%' THEN '"507f1f77bcf86cd799439011"' WHEN s LIKE '%date%' THEN '"2024-01-15"' WHEN s LIKE '%count%' THEN '0' WHEN s LIKE '%enabled%' OR s LIKE '%active%' THEN 'true' ELSE '"sample_value"' END AS example FROM (SELECT unnest(['doc_id', 'userName', 'lang', 'n_chars', 'isActive', 'phone_no']) AS source), LATERAL (SELECT lower(source) AS s)""")
def example_values(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("doc_id", "userName", "lang", "n_chars", "isActive", "phone_no")], "source string")
    return names.select("source", source_text.example_value("source").alias("example"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(p[1], '[^a-zA-Z]', '', 'g'), ''), 'default') AS tag, 'get_' || coalesce(nullif(array_to_string(p, '_'), ''), 'root') AS snake,
  'get' || array_to_string(list_transform(string_split_regex(coalesce(nullif(p[-1], ''), 'item'), '[-_]'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '') AS camel
FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)""")
def first_segment_tag(spark, sf_dir):
    df = table(spark, sf_dir, "pages").withColumn("p", F.regexp_extract("url", URL_PATH, 1))
    return df.select("page_id", paths.first_tag("p").alias("tag"), paths.snake_id(F.lit("GET"), "p").alias("snake"), paths.camel_id(F.lit("GET"), "p").alias("camel"))


@query(r"""SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '/(node_modules|\.[^/]+)/') AND regexp_extract(url, '^(\w+):', 1) IN ('https') AND contains(html, '<h1>')""")
def filter_prune(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    return df.where(F.col("url").rlike("/(en|fr)/") & ~F.col("url").rlike(r"/(node_modules|\.[^/]+)/") & F.regexp_extract("url", r"^(\w+):", 1).isin("https") & F.col("html").contains("<h1>")).select("page_id", "url")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS p_at FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, epoch_us(ts) AS c_at FROM events WHERE event_type = 'click'),
best AS (SELECT p.event_id, p.user_id, p_at, click_id, c_at, row_number() OVER (PARTITION BY p.event_id ORDER BY (c_at < p_at) DESC, c_at DESC, click_id) AS r FROM p LEFT JOIN c ON p.user_id = c.user_id AND c_at <= p_at)
SELECT event_id, user_id, CASE WHEN p_at - c_at <= 86400000000 THEN click_id END AS click_id, CASE WHEN p_at - c_at <= 86400000000 THEN p_at - c_at END AS gap FROM best WHERE r = 1""")
def asof_attach(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    p = events.where("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("at"))
    c = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), micros("ts").alias("click_at"))
    out = joins.asof_attach(p, c, ["user_id"], "at", "click_at", "click_id", 86_400_000_000, ["click_id"])
    return out.select("event_id", "user_id", "click_id", (F.col("at") - F.col("click_at")).alias("gap"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def documented_semi(spark, sf_dir):
    return joins.documented(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT c_custkey, c_name, e.event_id, e.event_type FROM customer LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) e ON c_custkey = e.user_id""")
def left_enrich_lastwins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", "event_type", F.col("event_id").alias("tie"))
    return joins.enrich_last_wins(c, e, ["c_custkey"], ["ts", "tie"]).select("c_custkey", "c_name", "event_id", "event_type")


@query("""SELECT d.doc_id, coalesce(length(a.text), length(b.text))::BIGINT AS item_chars FROM documents d LEFT JOIN benchmark a ON d.doc_id = a.item_id LEFT JOIN benchmark b ON d.doc_id % 100 = b.item_id""")
def two_key_coalesce(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("long").alias("item_chars"))
    return joins.two_key_lookup(table(spark, sf_dir, "documents").select("doc_id"), b, F.col("doc_id"), F.col("doc_id") % 100, "item_id", ["item_chars"])


@query("""SELECT o_orderkey, l.l_linenumber, l.l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""")
def first_line_of_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return joins.first_match(o, lines, ["o_orderkey"], ["l_linenumber", "l_partkey"])


# --- windows ----------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", windows.carry_forward(value, ["user_id"], ["ts", "event_id"]).alias("last_purchase"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def handler_span(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", windows.span_end(F.col("turn"), ["conv_id"], ["turn"]).alias("next_turn"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS done, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")
def running_progress(spark, sf_dir):
    return windows.progress(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("""SELECT conv_id, turn, coalesce(length(next) > length(text) + 20, false) AS improved FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)""")
def improved_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("next", windows.span_end(F.col("text"), ["conv_id"], ["turn"]))
    return df.select("conv_id", "turn", (F.col("next").isNotNull() & compare.longer("next", "text", 20)).alias("improved"))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("""SELECT lang, round(sum(quality * n_chars::DOUBLE) / sum(n_chars), 9) AS score FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def weighted_score(spark, sf_dir):
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("w")), "doc_id")
    return df.groupBy("lang").agg(F.round(aggregates.weighted_mean(F.col("quality").cast("double"), "w"), 9).alias("score"))


@query("""SELECT coalesce(avg(nullif(quality, 0)), 0)::DOUBLE AS quality, coalesce(avg(nullif(toxic, 0)), 0)::DOUBLE AS toxic, round(avg(CASE WHEN quality = 1 THEN toxic END), 9) AS toxic_of_good, round((avg(quality) + avg(toxic) + 0) / 3, 9) AS plain FROM labels""")
def mean_skip_zero(spark, sf_dir):
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return table(spark, sf_dir, "labels").agg(aggregates.mean_skipping_zeros(q).alias("quality"), aggregates.mean_skipping_zeros(t).alias("toxic"), F.round(aggregates.mean_of_successes(t, F.col("quality") == 1), 9).alias("toxic_of_good"), F.round((F.avg(q) + F.avg(t)) / 3, 9).alias("plain"))


@query("""SELECT lang, count(*) AS total, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(100 * count(quality)::DOUBLE / count(*)) AS labelled_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def conditional_counters(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), aggregates.percent(F.count("quality"), F.count("*")).alias("labelled_pct"))


@query("SELECT coalesce(role, 'all') AS role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ROLLUP (role)")
def subtotals(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").rollup("role").agg(F.count("*").alias("turns"), F.sum(F.length("text").cast("long")).alias("chars"))
    return df.withColumn("role", F.coalesce("role", F.lit("all")))


@query("SELECT tag, min(doc_id) AS first_seen FROM (SELECT doc_id, unnest([lang, source]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY tag")
def distinct_ordered(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", merge.ordered_union(F.array("lang"), F.array("source")).alias("tags"))
    return aggregates.first_seen(df, "tags", "tag", "doc_id").where("tag is not null")


@query("SELECT o_custkey, count(*)::INT AS n, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def nest_by_group(spark, sf_dir):
    g = aggregates.grouped(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_custkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"])
    return g.select("o_custkey", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("""SELECT o_custkey, array_to_string(list(o_orderstatus || '=' || k ORDER BY o_orderstatus), ',') AS latest FROM (SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def nested_map(spark, sf_dir):
    n = aggregates.nested(table(spark, sf_dir, "orders").withColumn("tie", F.col("o_orderkey")), "o_custkey", "o_orderstatus", "o_orderkey", ["o_orderdate", "tie"])
    return n.select("o_custkey", F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("latest"))


@query(r"""SELECT lower(regexp_extract(url, '://([^/]+)/', 1)) AS host, coalesce(nullif(lower(regexp_extract(url, '/(en|fr)/', 1)), ''), 'unknown') AS entity, count(*) AS n FROM pages GROUP BY ALL""")
def counts_with_default(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/]+)/", 1)).alias("host"), F.coalesce(paths.filled(F.lower(F.regexp_extract("url", "/(en|fr)/", 1))), F.lit("unknown")).alias("entity"))
    return df.groupBy("host", "entity").agg(F.count("*").alias("n"))


@query("""SELECT source, round(least(count(quality)::DOUBLE / (count(*) * 0.4::DOUBLE), 1), 9) AS ratio, round(100 * count(quality)::DOUBLE / count(*))::INT AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_ratio(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("k"), F.count("*").alias("n"))
    return df.select("source", F.round(aggregates.capped_ratio(F.col("k"), F.col("n") * F.lit(0.4)), 9).alias("ratio"), aggregates.percent(F.col("k"), F.col("n")).cast("int").alias("pct"))


@query("""SELECT count(*) AS expected, count(l.doc_id) AS found, count(l.doc_id)::DOUBLE / count(*) AS share FROM benchmark LEFT JOIN labels l ON item_id = l.doc_id""")
def expected_found(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return joins.found_share(e, table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT conv_id, turn, round(CASE WHEN l LIKE '%get%' AND text LIKE '%/api/users%' THEN 0.25 ELSE 0 END + CASE WHEN l LIKE '%post%' AND text LIKE '%/api/users%' THEN 0.25 ELSE 0 END + CASE WHEN l LIKE '%get%' AND text LIKE '%:id%' THEN 0.25 ELSE 0 END + CASE WHEN l LIKE '%auth%' OR l LIKE '%middleware%' THEN 0.15 ELSE 0 END + CASE WHEN l LIKE '%summary%' OR l LIKE '%description%' THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT *, lower(text) AS l FROM conversations)""")
def rubric_score(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(source_text.rubric("text"), 6).alias("score"))


# --- sets and merges --------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT page_id, list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS l FROM pages)
SELECT a.page_id, array_to_string(list_sort(list_filter(b.l, lambda x: NOT list_contains(a.l, x))), ',') AS added, array_to_string(list_sort(list_filter(a.l, lambda x: NOT list_contains(b.l, x))), ',') AS removed, len(b.l) > len(a.l) AS improved FROM l a JOIN l b ON b.page_id = a.page_id + 1""")
def field_diff(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.array_distinct(source_text.links("html")).alias("l"))
    x = links.join(links.select((F.col("page_id") - 1).alias("page_id"), F.col("l").alias("next")), "page_id")
    return x.select("page_id", F.array_join(F.array_sort(merge.added("next", "l")), ",").alias("added"), F.array_join(F.array_sort(merge.added("l", "next")), ",").alias("removed"), (F.size("next") > F.size("l")).alias("improved"))


@query("""WITH x AS (SELECT user_id, event_type, event_id % 2 AS side, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT user_id, event_type, arg_max(value, side) AS right_wins, arg_min(value, side) AS left_wins FROM x GROUP BY ALL""")
def map_merge(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("side")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))

    def side(k):
        return F.map_from_entries(F.collect_list(F.when(F.col("side") == k, F.struct("event_type", "value"))))

    maps = last.groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b"))
    both = maps.select("user_id", F.explode(F.map_zip_with(merge.right_wins("a", "b"), merge.left_wins("a", "b"), lambda _, r, v: F.struct(r.alias("r"), v.alias("l")))).alias("event_type", "v"))
    return both.select("user_id", "event_type", F.col("v.r").alias("right_wins"), F.col("v.l").alias("left_wins"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 5000 THEN c_name ELSE '' END, ''), nullif(s_name, ''), 'none') AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def precedence_coalesce(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise("").alias("own"))
    x = c.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return x.select("c_custkey", merge.first_filled("own", "s_name", F.lit("none")).alias("name"))


@query("SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_append(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("key"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return parts[0].unionByName(parts[1])


# --- sorts, limits, ranks, vectors ------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type AS model, event_type <> 'error' AS success, count(*) AS duration, round(avg(value) / 100, 6) AS score, min(event_id) AS ord FROM events GROUP BY event_type), v AS (
SELECT 'score' AS board, model, score AS value, row_number() OVER (ORDER BY score DESC, ord) AS place FROM r UNION ALL
SELECT 'speed', model, duration, row_number() OVER (ORDER BY duration, ord) FROM r WHERE success UNION ALL
SELECT 'combined', model, score * 0.7::DOUBLE + (1 - duration / 10000::DOUBLE) * 0.3::DOUBLE, row_number() OVER (ORDER BY score * 0.7::DOUBLE + (1 - duration / 10000::DOUBLE) * 0.3::DOUBLE DESC, ord) FROM r WHERE success)
SELECT board, place::INT AS place, model, round(value, 6)::DOUBLE AS value FROM v""")
def rank_models(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg((F.first("event_type") != "error").alias("success"), F.count("*").alias("duration"), F.round(F.avg("value") / 100, 6).alias("score"), F.min("event_id").alias("ord"))
    return evaluate.rankings(r).withColumn("value", F.round("value", 6))


@query("""SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 5""")
def topk_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id = 0").select("embedding").first()
    found = vectors.nearest(v, list(asked[0]) if asked else [], 5, key="vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT query_id, vec_id, place::INT AS place, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS place FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE place <= 5 AND place > 1""")
def nearest_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = vectors.nearest_to_each(v, q, 5, key="vec_id").where("place > 1")
    return found.select("query_id", F.col("id").alias("vec_id"), "place", F.round("distance", 6).alias("distance"))


@query("""SELECT source, string_agg(substr(text, 1, 80), '|' ORDER BY doc_id) FILTER (r <= 3) AS examples, count(*) - least(count(*), 3) AS others, min(doc_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source""")
def first_n_examples(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 80).alias("t"))
    top = df.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("r <= 3")  # each task keeps three of a source
    top = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("top"))
    counts = df.groupBy(F.col("source").alias("s")).agg((F.count("*") - F.least(F.count("*"), F.lit(3))).alias("others"), F.min("doc_id").alias("first_id"))
    joined = top.join(counts, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("source", F.array_join(F.transform("top", lambda x: x["t"]), "|").alias("examples"), "others", "first_id")


# --- source text ------------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('users.js', 0, 'GET', '/api/crm/users', 24, 'express', 'auth', 'inline', 'anonymous'), ('users.js', 1, 'POST', '/api/crm/users', 39, 'express', 'auth,validatePermission', 'inline', 'anonymous'), ('users.js', 2, 'POST', 'https://mail.example.com/send', 42, 'express', '', NULL, NULL), ('users.js', 3, 'DELETE', '/api/crm/users/:id', 46, 'express', 'requireAuth', 'reference', 'removeUser'), ('zones.js', 0, 'GET', '/api/crm/zones/', 3, 'nestjs', '', 'method', 'findAll'), ('zones.js', 1, 'GET', '/api/crm/zones/:id', 6, 'nestjs', '', 'method', 'findOne')) t(file, ord, method, path, line, framework, middleware, handler_type, handler_name)""")
def routes_from_source(spark, sf_dir):
    return project.routes(fixtures.sources(spark)).select("file", "ord", "method", "path", "line", "framework", F.array_join("middleware", ",").alias("middleware"), F.col("handler.type").alias("handler_type"), F.col("handler.name").alias("handler_name"))


@query("""SELECT * FROM (VALUES ('users.js', 'GET', '/api/crm/users', NULL::INT, NULL), ('users.js', 'POST', '/api/crm/users', 30, 'Create a user'), ('users.js', 'POST', 'https://mail.example.com/send', NULL, NULL), ('users.js', 'DELETE', '/api/crm/users/:id', NULL, NULL), ('zones.js', 'GET', '/api/crm/zones/', NULL, NULL), ('zones.js', 'GET', '/api/crm/zones/:id', NULL, NULL)) t(file, method, path, doc_line, doc_summary)""")
def documented_routes(spark, sf_dir):
    s = fixtures.sources(spark)
    return project.documented_routes(project.routes(s), comments.extract_comments(s)).select("file", "method", "path", "doc_line", "doc_summary")


@query("""SELECT * FROM (VALUES ('DELETE /api/crm/users/:id', 'service', 'UserService'), ('DELETE /api/crm/users/:id', 'table', 'User'), ('DELETE /api/crm/users/:id', 'table', 'UserService'), ('DELETE /api/crm/users/:id', 'url', 'https://mail.example.com/send'), ('GET /api/crm/users', 'service', 'UserService'), ('GET /api/crm/users', 'table', 'User'), ('GET /api/crm/users', 'table', 'UserService'), ('GET /api/crm/users', 'url', 'https://mail.example.com/send'), ('GET /api/crm/zones/', 'table', 'Zone'), ('GET /api/crm/zones/', 'url', 'https://geo.example.com/zone'), ('GET /api/crm/zones/:id', 'table', 'Zone'), ('GET /api/crm/zones/:id', 'url', 'https://geo.example.com/zone'), ('POST /api/crm/users', 'service', 'UserService'), ('POST /api/crm/users', 'table', 'User'), ('POST /api/crm/users', 'table', 'UserService'), ('POST /api/crm/users', 'url', 'https://mail.example.com/send'), ('POST https://mail.example.com/send', 'service', 'UserService'), ('POST https://mail.example.com/send', 'table', 'User'), ('POST https://mail.example.com/send', 'table', 'UserService'), ('POST https://mail.example.com/send', 'url', 'https://mail.example.com/send')) t(endpoint, kind, target)""")
def dependency_edges(spark, sf_dir):
    s = fixtures.sources(spark)
    return project.edges(project.relationships(project.routes(s), s))


@query()
def openapi_doc(spark, sf_dir):
    return project.openapi(fixtures.sources(spark))


@query("SELECT * FROM (VALUES ('GET', '/api/crm/users', 'improved', 'List', 'Authorization,limit', ''), ('POST', '/api/crm/users', 'new', NULL, 'Authorization,page,limit', ''), ('POST', 'https://mail.example.com/send', 'new', NULL, 'page,limit', ''), ('DELETE', '/api/crm/users/:id', 'new', NULL, 'Authorization', ''), ('GET', '/api/crm/zones/', 'new', NULL, '', ''), ('GET', '/api/crm/zones/:id', 'new', NULL, '', '')) t(method, path, state, original_summary, params_added, params_removed)")
def compared_docs(spark, sf_dir):
    return project.comparison(fixtures.sources(spark)).select("method", "path", "state", "original_summary", F.array_join("params_added", ",").alias("params_added"), F.array_join("params_removed", ",").alias("params_removed"))


@query()
def comparison_report(spark, sf_dir):
    return compare.markdown_report(project.comparison(fixtures.sources(spark)))


@query()
def doc_patches(spark, sf_dir):
    return project.project_patches(fixtures.sources(spark))


@query("""SELECT "case", parsing::DOUBLE AS parsing, swagger::DOUBLE AS swagger, generation::DOUBLE AS generation, overall::DOUBLE AS overall, passed FROM (VALUES ('simple-express', 1.0::DOUBLE, 0.428571, 0.0::DOUBLE, 0.47619, false), ('middleware-chains', 1.0, 0.428571, 0.0, 0.47619, false), ('nestjs-decorators', 1.0, 0.428571, 0.0, 0.47619, false), ('jsdoc-documentation', 1.0, 1.0, 0.0, 0.666667, false), ('openapi-generation', 0.0, 0.0, 1.0, 0.333333, false)) t("case", parsing, swagger, generation, overall, passed)""")
def evaluation_scores(spark, sf_dir):
    out = project.evaluation(fixtures.cases(spark), fixtures.expected(spark))
    return out.select("case", *[F.round(c, 6).alias(c) for c in ("parsing", "swagger", "generation", "overall")], "passed")


@query()
def embedded_endpoints(spark, sf_dir):
    r = project.routes(fixtures.sources(spark)).withColumn("document", vectors.embedding_text("method", "path", "handler.name", F.array("middleware"), F.array("middlewareLines"), F.lit("")))
    return vectors.index_endpoints(r)


@query("SELECT event_type AS name, arg_max(props, event_id) AS schema FROM events GROUP BY event_type")
def schema_registry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return openapi.schema_registry(e.select(F.col("event_type").alias("name"), F.col("props").alias("schema"), F.col("event_id").alias("ord")))


@query("SELECT entity, operations::BIGINT AS operations, with_parameters::BIGINT AS with_parameters, with_body::BIGINT AS with_body, responses::BIGINT AS responses FROM (VALUES ('crm/users', 3, 3, 1, 19), ('crm/zones', 2, 1, 0, 10), ('other', 1, 1, 1, 8), ('all', 6, 5, 2, 37)) t(entity, operations, with_parameters, with_body, responses)")
def extraction_totals(spark, sf_dir):
    s = fixtures.sources(spark)
    ops = openapi.operations(openapi.enriched(project.routes(s), s)).select(F.coalesce(paths.filled(F.regexp_extract("path", "^/api/(crm/[^/]+)", 1)), F.lit("other")).alias("entity"), "operation")
    return openapi.extraction_totals(ops)


@query("SELECT * FROM (VALUES ('GET', '/api/crm/users', 'users.js', 24, 'express', 'anonymous', 1, 2, false), ('POST', '/api/crm/users', 'users.js', 39, 'express', 'anonymous', 2, 2, true), ('POST', 'https://mail.example.com/send', 'users.js', 42, 'express', 'anonymous', 0, 0, false), ('DELETE', '/api/crm/users/:id', 'users.js', 46, 'express', 'removeUser', 1, 0, false), ('GET', '/api/crm/zones/', 'zones.js', 3, 'nestjs', 'findAll', 0, 0, false), ('GET', '/api/crm/zones/:id', 'zones.js', 6, 'nestjs', 'findOne', 0, 0, false)) t(method, path, file, line, framework, handler, middleware_count, params, has_docs)")
def route_summaries(spark, sf_dir):
    s = fixtures.sources(spark)
    return project.summary_rows(project.documented_routes(project.routes(s), comments.extract_comments(s)))


@query()
def change_request(spark, sf_dir):
    return compare.request_text(project.project_patches(fixtures.sources(spark)))


# --- programs made of documents ------------------------------------------------------------------------------------------


def programs(spark, sf_dir) -> DataFrame:
    """One small source file for each document: a doc block, some empty lines, a route whose parts follow from the document, and a ``@swagger`` block."""
    number, lang = F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("none"))
    verb = F.element_at(F.array(*map(F.lit, ("get", "post", "put", "delete"))), (F.col("doc_id") % 4 + 1).cast("int"))
    extra = F.when(F.col("doc_id") % 3 == 0, "auth").otherwise("[auth, check(1)]")
    parts = [
        F.lit("const router = express.Router();\n/**\n * @summary Text "), number, F.lit("\n * @tags "), lang, F.lit("\n */\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 15).cast("int")),
        F.lit("router."), verb, F.lit("('/api/"), lang, F.lit("/:id/"), number, F.lit("', "), extra, F.lit(", (req, res) => {\n  DocService.find("), number, F.lit(");\n});\n\n/**\n * @swagger\n * /docs/"), number,
        F.lit(":\n *   "), verb, F.lit(":\n *     summary: Block "), number, F.lit("\n */\n"),
    ]
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), number, F.lit(".js")).alias("file"), F.concat(*parts).alias("src"))


@query("""SELECT 'doc_' || doc_id || '.js' AS file, ['GET', 'POST', 'PUT', 'DELETE'][doc_id % 4 + 1] AS method, '/api/' || coalesce(lang, 'none') || '/:id/' || doc_id AS path, (6 + doc_id % 15)::INT AS line,
  'express' AS framework, CASE WHEN doc_id % 3 = 0 THEN 'auth' ELSE 'auth,check' END AS middleware, CASE WHEN doc_id % 15 <= 6 THEN 2 END AS doc_line, CASE WHEN doc_id % 15 <= 6 THEN 'Text ' || doc_id END AS doc_summary FROM documents""")
def program_routes(spark, sf_dir):
    s = programs(spark, sf_dir)
    found = project.documented_routes(project.routes(s), comments.extract_comments(s))
    return found.select("file", "method", "path", "line", "framework", F.array_join("middleware", ",").alias("middleware"), "doc_line", "doc_summary")


@query("""SELECT 'doc_' || doc_id || '.js' AS file, ['GET', 'POST', 'PUT', 'DELETE'][doc_id % 4 + 1] || ' /docs/' || doc_id AS key, (10 + doc_id % 15)::INT AS start_line, (15 + doc_id % 15)::INT AS end_line, 'Block ' || doc_id AS summary,
  md5('/**' || chr(10) || ' * @swagger' || chr(10) || ' * /docs/' || doc_id || ':' || chr(10) || ' *   ' || ['get', 'post', 'put', 'delete'][doc_id % 4 + 1] || ':' || chr(10) || ' *     summary: Block ' || doc_id || chr(10) || ' */') AS block FROM documents""")
def program_blocks(spark, sf_dir):
    return comments.swagger_spans(programs(spark, sf_dir)).select("file", "key", "start_line", "end_line", "summary", F.md5("block").alias("block"))


@query("""SELECT 'doc_' || doc_id || '.js' AS file, ['GET', 'POST', 'PUT', 'DELETE'][doc_id % 4 + 1] || ' ' || unnest(['/api/' || coalesce(lang, 'none') || '/:id/' || doc_id, 'api/' || coalesce(lang, 'none') || '/:id/' || doc_id]) AS key, (6 + doc_id % 15)::INT AS line FROM documents""")
def program_positions(spark, sf_dir):
    return route_positions(programs(spark, sf_dir)).select("file", "key", "line")


@query("""SELECT ['GET', 'POST', 'PUT', 'DELETE'][doc_id % 4 + 1] || ' /api/' || coalesce(lang, 'none') || '/:id/' || doc_id AS endpoint, 'service' AS kind, 'DocService' AS target FROM documents""")
def program_edges(spark, sf_dir):
    s = programs(spark, sf_dir)
    return project.edges(project.relationships(project.routes(s), s)).where("kind = 'service'")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
