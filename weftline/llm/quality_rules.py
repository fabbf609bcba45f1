"""Quality rules (native): per-document base rules and cross-document line frequency.

Lines are lower-cased, their white space squeezed, and hashed. A line is boilerplate on a host (the source) if more of the host's distinct documents than its limit hold it:
``max_share`` of the host's documents, but ``max_docs`` at least and ``most_docs`` at most, however large the host. Such lines are removed; a document of which less than ``min_left`` of its
words is left is depleted and rejected. ``clean_documents`` returns what is kept, with the lines removed.

Nulls: a null text has no words and fails the base rules; null sources form one host; null ids are kept as they are. Repeated rows count as
documents of their own and get equal values. An empty table gives an empty result. Other columns, whatever their names, are carried by ``clean_documents`` and else not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE_CLASS, SPACES, table, words

MAX_SHARE, MAX_DOCS, MOST_DOCS, MIN_LEFT = 0.01, 10, 100, 0.5


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; all work stays within the row, so nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumns({
        "_w": words(text), "_l": lines,
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
    })
    windows = F.expr("if(size(_w) >= 3, transform(sequence(0, greatest(size(_w) - 3, 0)), i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i)), array())")
    two = one.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_s": F.sort_array(windows),
    }).drop("_w", "_l")
    # in sorted order equal windows stand side by side
    three = two.withColumn("_d", F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(_s) and _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i))")).drop("_s")
    covered = F.expr("aggregate(transform(_d, (x, k) -> if(k + 1 < size(_d), least(3, _d[least(k + 1, size(_d) - 1)] - x), 3)), 0L, (a, x) -> a + x)")
    return three.withColumn("n_repeat_words", covered).drop("_d")


def line_rows(docs: DataFrame, *keep: str, text: str = "text", distinct: bool = False) -> DataFrame:
    """The normalised lines that have a word: ``keep``, pos, line_hash, line_words. distinct: each line once for each row of docs."""
    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*", "\n"))
    lines = F.split(F.regexp_replace(squeezed, r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    exploded = docs.select(*keep, F.posexplode(F.array_distinct(lines) if distinct else lines).alias("pos", "line"))
    line = F.trim("line")
    return exploded.select(*keep, "pos", line.alias("line")).where("line <> ''").select(
        *keep, "pos", F.xxhash64("line").alias("line_hash"), (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).cast("long").alias("line_words"))


def frequent_lines(docs: DataFrame, source: str = "source", text: str = "text", max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """The lines above the limits: host, line_hash, n_docs. Counts are pre-aggregated in each task, so a common line isn't gathered."""
    hosts = docs.groupBy(F.col(source).alias("host")).agg(F.count("*").alias("host_docs"))
    counts = line_rows(docs.select(F.col(source).alias("host"), F.col(text).alias("text")), "host", distinct=True).groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"))
    counts = counts.where(F.col("n_docs") > max_docs)
    joined = counts.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return joined.where(F.col("n_docs") > F.least(F.lit(float(most_docs)), F.lit(max_share) * F.col("host_docs"))).select("host", "line_hash", "n_docs")


def _judged(docs: DataFrame, doc_id: str, source: str, text: str, keep: bool, min_left: float, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed_words, n_removed_lines, kept and, if asked for, row (all columns) and gone (hashes of removed lines)."""
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"), *rows)
    often = frequent_lines(keyed, **limits)
    lines = line_rows(keyed.withColumnRenamed("source", "src"), "doc_id", "src", "key")
    hit = lines.join(often.withColumnRenamed("line_hash", "lh"), (F.col("line_hash") == F.col("lh")) & F.col("src").eqNullSafe(F.col("host")))
    hit = hit.groupBy("doc_id", "src", "key", "pos").agg(F.max("line_words").alias("line_words"), *([F.max("line_hash").alias("line_hash")] if keep else []))  # rows that repeat count once
    gone = [F.collect_set("line_hash").alias("gone")] if keep else []
    removed = hit.groupBy(F.col("doc_id").alias("d"), F.col("src").alias("s"), F.col("key").alias("k")).agg(F.sum("line_words").alias("n_removed_words"), F.count("*").alias("n_removed_lines"), *gone)
    base = base_counts(keyed).drop("text")
    base = base.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    out = base.join(removed, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_removed_words", "n_removed_lines")})
    # one comparison: of a conjunction a later filter would push the base rules below the join and there work them out anew, inside of their own loops
    bar = F.when(F.col("base_failed"), F.col("n_words") + 1.0).otherwise(F.lit(min_left) * F.col("n_words"))
    return out.withColumn("kept", F.col("n_words") - F.col("n_removed_words") >= bar)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed_words, n_removed_lines, kept: one row for each row of ``docs``."""
    out = _judged(docs, doc_id, source, text, False, min_left, **limits)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines")


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, the frequent lines taken out of their texts; the other lines stay as they are."""
    out = _judged(docs, doc_id, source, text, True, min_left, **limits).where("kept")

    def hashed(line):
        return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09\x0B-\x0D]+", " ")))

    own = F.col(f"row.`{text}`")
    cleaned = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(F.filter(F.split(own, "\n"), lambda x: ~F.array_contains(F.col("gone"), hashed(x))), "\n"))
    return out.select(*[(cleaned if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
base AS (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
norm AS (SELECT r, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM d, LATERAL (SELECT unnest(string_split(t, chr(10))) AS x)),
lines AS (SELECT * FROM norm WHERE line <> ''),
often AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT r) AS n FROM lines GROUP BY ALL) q
  JOIN (SELECT source AS s, count(*) AS docs FROM d GROUP BY ALL) h ON q.source IS NOT DISTINCT FROM h.s
  WHERE n > 10 AND n > least(100::DOUBLE, 0.01::DOUBLE * docs)),
gone AS (
  SELECT r, sum(len(string_split(lines.line, ' ')))::BIGINT AS n_removed_words, count(*) AS n_removed_lines
  FROM lines JOIN often ON lines.line = often.line AND lines.source IS NOT DISTINCT FROM often.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(n_removed_words, 0) >= 0.5::DOUBLE * n_words AS kept,
  coalesce(n_removed_words, 0) AS n_removed_words, coalesce(n_removed_lines, 0) AS n_removed_lines
FROM base LEFT JOIN gone USING (r)
"""
