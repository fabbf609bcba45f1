"""Mixing sources to target weights (native): equal-token blocks, dealt to sources by Sainte-Lague apportionment.

Sources in code point order, null last, weigh ``weights`` in turn and share all tokens; a target stops at ``max_epochs`` times its source and the
excess is reshared by weight. All tokens are cut into seats of one block each, the last one shorter, and each seat goes to the highest quotient target / (2k + 1)
of a source that can still take one, k being the number of seats it has; a source's last seat is cut where ``max_epochs`` times its words end. A block
has ``block`` words, or fewer if there are so many sources that they have under ``LEAST_BLOCKS`` blocks each on average.

The documents of a source go to its shards of about ``shard_tokens`` words by hash of id and text. A shard's quota is the share of its source's words that ends
with it, less what the shards before it have had, so remainders are carried on and quotas add up to the word. In a shard the words, documents in seeded order, are
one sequence, cut into blocks. A quota takes whole passes of the sequence while they fit, then blocks in seeded order, the last one cut.

Nulls: a null text has size 0; null sources are one source, the last; null ids hash as text, together with where the row lies in its file if that is known.
Repeated rows are documents of their own. Rows without words are in no shard and take nothing; sources without words get the target 0. An empty
table gives an empty result. Ties are broken by hash, id and size, so reruns agree. Other columns, whatever their names, are carried by ``mixed_documents`` and not
read by ``mix_sources``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, place_in_file, table, words, written

WEIGHTS, MAX_EPOCHS, BLOCK, LEAST_BLOCKS, SHARD_TOKENS, SEED = (5, 2, 1), 3, 128, 64, 200_000, 7
#: Shards whose quotas are added up in one go; the sums of such bands are added up before.
BAND = 1024


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, size)`` to source, source_size, target, rank: least(cap, level * weight), the level being the one at which targets sum to all words.

    Of the levels that don't pass the cap of the first source they leave free, the highest is the right one: beyond it they only fall. The windows run
    over one row for each source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"), "rank")


def source_words(targets: DataFrame, total: int, block: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``targets(source, source_size, target, rank)`` to source, words: by highest quotients.

    The seats are those whose quotients reach a divisor. A source's number of seats at a divisor is within a half of target / (2 * divisor), so two divisors are known
    of which one gives too few seats and the other enough, with a few seats for each source between them; where sources run out of words, the smaller divisor goes
    down until there are enough. Each source keeps all but one of the seats that the larger divisor gives, and the quotients in between are ranked. Only counts reach the driver.
    """
    seats, rest = -(-total // block), total % block or block
    each = targets.where("target > 0").withColumn("most", F.expr(f"({max_epochs} * source_size + {block - 1}) div {block}"))

    def given(divisor: float) -> Column:
        """Seats whose quotients are at least the divisor."""
        return F.least(F.col("most"), F.floor((F.col("target") / divisor + 1) / 2))

    wanted, sources, most = each.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*"), F.coalesce(F.sum("most"), F.lit(0))).first()
    few, step = max(1e-300, wanted / max(1, 2 * seats - sources)) * (1 + 1e-9), 2
    many = max(1e-300, wanted / (2 * seats + step * sources + 1))
    while (each.agg(F.sum(given(many))).first()[0] or 0) < min(seats, most):
        step *= 2
        many = wanted / (2 * seats + step * sources + 1)
    each = each.withColumns({"sure": F.greatest(F.lit(0), given(few) - 1).cast("long"), "may": F.least(F.col("most"), given(many) + 1).cast("long")})
    left = seats - (each.agg(F.sum("sure")).first()[0] or 0)
    bids = each.where("may > sure").select("source", "rank", "target", F.explode(F.expr("sequence(sure, may - 1)")).alias("k"))
    bids = bids.withColumn("bid", F.row_number().over(Window.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "rank", "k"))).where(F.col("bid") <= left)
    won = bids.groupBy(F.col("rank").alias("r")).agg(F.count("*").alias("won"), F.max(F.col("bid") == left).alias("ends"))
    cap = F.lit(max_epochs) * F.col("source_size")
    n = F.col("sure") + F.coalesce("won", F.lit(0))
    ended = F.when(F.col("ends"), F.least(F.lit(block), cap - (n - 1) * block) - F.least(F.lit(rest), cap - (n - 1) * block)).otherwise(0)  # the seat of the last words is shorter
    return each.join(won, F.col("rank") == F.col("r"), "left").select("source", (F.least(n * block, cap) - ended).alias("words"))


def _number(*parts) -> Column:
    """A 32-bit number from the md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _same(left: str | Column, right: str | Column) -> Column:
    return (F.col(left) if isinstance(left, str) else left).eqNullSafe(F.col(right) if isinstance(right, str) else right)


def _keyed(docs: DataFrame, doc_id: str, source: str, text: str, keep: bool) -> DataFrame:
    """doc_id, source, size, key, place and, if asked for, row: what the plan knows of a document."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    size = F.size(words(text)).cast("long")
    return place_in_file(docs, lambda place: [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"), F.when(F.col(doc_id).isNull(), place).otherwise(F.lit("")).alias("place"), *row])


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, keep: bool = False) -> DataFrame:
    """The rows of ``docs`` with their place in the mix: doc_id, source, size, source_size, target, shard, start, passes, parts and, if ``keep``, row (all columns).

    parts: the pieces that are taken once more, an array of first (word, from 0) and length. A shard's chosen blocks travel as bits, 64 in a number, in the row of its
    quota, so documents meet their blocks in the join that brings the quota.
    """
    sizes = written(_keyed(docs, doc_id, source, text, False), "mix-sizes")
    targets = written(source_targets(sizes, weights, max_epochs), "mix-targets")
    total, sources = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count_if(F.col("source_size") > 0)).first()
    block = max(1, min(block, total // (LEAST_BLOCKS * max(1, sources))))
    won = written(targets.join(source_words(targets, total, block, max_epochs).withColumnRenamed("source", "ws"), _same("source", "ws"), "left").select(
        "source", "rank", "source_size", "target", F.coalesce("words", F.lit(0)).alias("words"), F.greatest(F.lit(1), F.expr(f"(source_size + {shard_tokens - 1}) div {shard_tokens}")).alias("shards")), "mix-won")
    t = won.select(F.col("source").alias("ts"), "rank", "source_size", "target", "words", "shards")  # from here on a source goes by its rank, which is never null

    def sharded(rows: DataFrame) -> DataFrame:
        found = rows.join(t, _same("source", "ts")).drop("ts")
        return found.withColumn("shard", F.when(F.col("size") > 0, F.pmod(_number(F.lit(f"shard{seed}"), "key", "place"), F.col("shards"))))

    shares = sharded(sizes).where("size > 0").groupBy("rank", "shard", "source_size", "words").agg(F.sum("size").alias("tokens"))
    shares = written(shares.withColumn("band", F.expr(f"shard div {BAND}")), "mix-shares")
    bands = shares.groupBy(F.col("rank").alias("br"), F.col("band").alias("b")).agg(F.sum("tokens").alias("sum"))
    bands = bands.withColumn("before", F.sum("sum").over(Window.partitionBy("br").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum"))
    ends = F.col("before") + F.sum("tokens").over(Window.partitionBy("rank", "band").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quotas = shares.join(bands, (F.col("rank") == F.col("br")) & (F.col("band") == F.col("b"))).withColumn("ends", ends)
    upto = "cast({0} as decimal(19,0)) * cast(words as decimal(19,0)) div source_size"
    quotas = quotas.withColumn("quota", F.expr(upto.format("ends")) - F.expr(upto.format("(ends - tokens)")))
    quotas = quotas.select("rank", "shard", "tokens", F.expr("quota div tokens").alias("passes"), (F.col("quota") % F.col("tokens")).alias("rest"))

    blocks = quotas.where("rest > 0").select("rank", "shard", "rest", "tokens", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block})")).alias("block"))
    blocks = blocks.withColumn("length", F.least(F.lit(block), F.col("tokens") - F.col("block") * block))
    blocks = blocks.withColumn("order", F.md5(F.concat_ws(":", F.lit(f"block{seed}"), "rank", "shard", "block")))
    seeded = Window.partitionBy("rank", "shard").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("part", F.least(F.col("length"), F.col("rest") - F.sum("length").over(seeded) + F.col("length"))).where("part > 0")
    bits = blocks.groupBy("rank", "shard", F.expr("block div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(block % 64 as int))")).alias("bits"), F.max(F.when(F.col("part") < F.col("length"), F.struct("block", "part"))).alias("cut"))
    chosen = bits.groupBy(F.col("rank").alias("cr"), F.col("shard").alias("cs")).agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("bits"), F.max("cut").alias("cut"))
    q = quotas.join(chosen, (F.col("rank") == F.col("cr")) & (F.col("shard") == F.col("cs")), "left").select(F.col("rank").alias("qr"), F.col("shard").alias("qs"), "passes", "bits", "cut")
    q = written(q, "mix-quotas")

    line = Window.partitionBy("rank", "shard").orderBy("order", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sharded(_keyed(docs, doc_id, source, text, True) if keep else sizes)
    some = placed.where("size > 0").withColumn("order", F.md5(F.concat_ws(":", F.lit(f"doc{seed}"), "key"))).withColumn("start", F.sum("size").over(line) - F.col("size"))
    some = some.join(q.hint("merge"), (F.col("rank") == F.col("qr")) & (F.col("shard") == F.col("qs")))
    own = F.expr(f"filter(sequence(start div {block}, (start + size - 1) div {block}), b -> shiftright(coalesce(bits[b div 64], 0L), cast(b % 64 as int)) & 1 = 1)")
    part = F.expr(f"""transform(own, b -> named_struct('first', greatest(start, b * {block}) - start, 'end',
        least(start + size, b * {block} + if(b <=> cut.block, cut.part, {block})) - start))""")
    some = some.withColumn("own", F.when(F.col("bits").isNull(), F.array().cast("array<bigint>")).otherwise(own)).withColumn("parts", part)
    some = some.withColumn("parts", F.expr("transform(filter(parts, p -> p.end > p.first), p -> named_struct('first', p.first, 'length', p.end - p.first))"))
    columns = ["doc_id", "source", "size", "source_size", "target", "shard", "start", "passes", "parts", *(["row"] if keep else [])]
    none = placed.where("size = 0").withColumns({"start": F.lit(None).cast("long"), "passes": F.lit(0).cast("long"), "parts": F.array().cast("array<struct<first:bigint,length:bigint>>")})
    discard(targets, shares, *([sizes] if keep else []))
    return some.select(*columns).unionByName(none.select(*columns))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shard: one row for each row of ``docs``."""
    plan = plan_mix(docs, **options)
    taken = F.col("size") * F.col("passes") + F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shard")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, once for each whole pass, and once more with the words of their taken blocks, one space
    between, if those are a part; a column n_chars then tells the length of the new text. Documents that the mix doesn't take go. The texts are shuffled once, to their shards.
    """
    plan = plan_mix(docs, text=text, keep=True, **options).where("passes > 0 or size(parts) > 0").select("row", "passes", "parts", "size")
    own, length = F.col(f"row.`{text}`"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    plan = plan.withColumn("words", F.when((F.size("parts") > 0) & (length < F.col("size")), words(own)))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("words"), (p["first"] + 1).cast("int"), p["length"].cast("int")))), " ")
    again = F.when(F.size("parts") == 0, F.array().cast("array<string>")).when(F.col("words").isNull(), F.array(own)).otherwise(F.array(cut))
    plan = plan.select("row", F.explode(F.concat(F.array_repeat(own, F.col("passes").cast("int")), again)).alias("new"))
    new = {text: F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return plan.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH sizes AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
total AS (SELECT coalesce(sum(source_size), 0)::BIGINT AS total, greatest(1, least(128, coalesce(sum(source_size), 0) // (64 * greatest(1, count(*) FILTER (source_size > 0)))))::BIGINT AS block FROM per),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, ((SELECT total FROM total)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT max(level) FILTER (level * weight <= cap) AS level FROM levels),
targets AS (SELECT source, source_size, rank, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM weighed),
quotients AS (
  SELECT source, rank, k, target / (2 * k + 1) AS quotient, least(block, 3 * source_size - k * block) AS length
  FROM targets, total, LATERAL (SELECT unnest(generate_series(0, (3 * source_size - 1) // block)) AS k) WHERE target > 0),
seats AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, rank, k) AS seat FROM quotients),
won AS (SELECT source, sum(least(length, total - (seat - 1) * block))::BIGINT AS words FROM seats, total WHERE (seat - 1) * block < total GROUP BY source),
sources AS (SELECT t.source, t.rank, source_size, target, coalesce(words, 0) AS words, greatest(1, (source_size + 199999) // 200000) AS shards FROM targets t LEFT JOIN won w ON t.source IS NOT DISTINCT FROM w.source),
sharded AS (SELECT s.*, t.rank, source_size, target, words, CASE WHEN size > 0 THEN ('0x' || substr(md5('shard7:' || key || ':'), 1, 8))::BIGINT % shards END AS shard FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY md5('doc7:' || key), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start FROM sharded WHERE size > 0),
shares AS (SELECT rank, shard, source_size, words, sum(size)::BIGINT AS tokens FROM placed GROUP BY ALL),
quotas0 AS (SELECT *, sum(tokens) OVER (PARTITION BY rank ORDER BY shard)::HUGEINT AS ends FROM shares),
quotas1 AS (SELECT rank, shard, tokens, (ends * words // source_size - (ends - tokens) * words // source_size)::BIGINT AS quota FROM quotas0),
quotas AS (SELECT rank, shard, tokens, quota // tokens AS passes, quota % tokens AS rest FROM quotas1),
blocks0 AS (
  SELECT rank, shard, rest, b, least(block, tokens - b * block) AS length, md5('block7:' || rank || ':' || shard || ':' || b) AS ord
  FROM quotas, total, LATERAL (SELECT unnest(generate_series(0, (tokens - 1) // block)) AS b) WHERE rest > 0),
blocks AS (SELECT rank, shard, b, least(length, rest - sum(length) OVER (PARTITION BY rank, shard ORDER BY ord, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + length) AS part FROM blocks0),
parts AS (
  SELECT p.rank, p.shard, p.start, sum(greatest(0, least(p.start + p.size, k.b * block + k.part) - greatest(p.start, k.b * block))) AS more
  FROM (SELECT *, unnest(generate_series(start // block, (start + size - 1) // block)) AS b FROM placed, total) p
  JOIN blocks k ON p.shard = k.shard AND p.rank = k.rank AND p.b = k.b AND k.part > 0 GROUP BY ALL)
SELECT s.doc_id, s.size, s.source_size, s.target, (s.size * coalesce(q.passes, 0) + coalesce(m.more, 0))::BIGINT AS taken, s.shard
FROM sharded s LEFT JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.key = p.key AND s.rank = p.rank
LEFT JOIN quotas q ON p.shard = q.shard AND p.rank = q.rank
LEFT JOIN parts m ON p.shard = m.shard AND p.rank = m.rank AND p.start = m.start
"""
