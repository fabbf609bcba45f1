"""URL filters: rules by host and path, then a character language-model ratio.

Urls for which a rule decides are the labelled ones. For each verdict a variable-order Markov model of characters (contexts up to ``ORDER``,
Witten-Bell smoothing down to a uniform model of bytes) is fitted on a sample of at most ``SAMPLE`` of its distinct urls, drawn by hash. A url's score is
the log-likelihood difference of the two models, divided by its length; a logistic fit on a held-out fifth of the sample calibrates it. Every url is
scored; the method's verdict counts where no rule does.

Nulls: a null url and one without "://" have an empty host and path, no rule, and are scored as empty, at the middle. Repeated rows give repeated
results. Without labelled urls of both kinds every url scores at the middle and is allowed. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import drawn_by_hash, table

#: Fixed rules: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER, SAMPLE, SEED = 5, 20_000, 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(col, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(col, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for h, p, verdict in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


class Markov:
    """Counts of characters after contexts of up to ORDER characters; probabilities by Witten-Bell smoothing."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order, self.next, self.total = order, Counter(), Counter()
        for u in urls:
            text = "\n" * order + u + "\n"
            for i in range(order, len(text)):
                for k in range(order + 1):
                    self.next[text[i - k : i + 1]] += 1
                    self.total[text[i - k : i]] += 1
        self.kinds = Counter(g[:-1] for g in self.next)
        self.seen: dict[str, float] = {}

    def probability(self, gram: str) -> float:
        """Of the last character after the others."""
        p = 1 / 256
        for k in range(len(gram) - 1, -1, -1):
            context = gram[k:-1]
            n = self.total.get(context)
            if not n:
                break
            q = self.kinds[context]
            p = (self.next.get(gram[k:], 0) + q * p) / (n + q)
        return p

    def log(self, url: str) -> float:
        text, total, seen, order = "\n" * self.order + url + "\n", 0.0, self.seen, self.order
        for i in range(order, len(text)):
            gram = text[i - order : i + 1]
            value = seen.get(gram)
            if value is None:
                if len(seen) > 200_000:  # the memory of probabilities is bounded
                    seen.clear()
                value = seen[gram] = log(self.probability(gram))
            total += value
        return total


def ratio(url: str, accepted: Markov, rejected: Markov) -> float:
    return (accepted.log(url) - rejected.log(url)) / (len(url) + 1)


def calibrated(scores: list[float], labels: list[int], steps: int = 500) -> tuple[float, float]:
    """Slope and shift of a logistic fit in which both labels weigh the same; scores are scaled first."""
    import numpy as np

    x, y = np.array(scores), np.array(labels, float)
    if len(set(labels)) < 2:
        return 1.0, 0.0
    scale = float(np.std(x)) or 1.0
    x = x / scale
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 1.0, 0.0
    for _ in range(steps):
        g = w * (1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) - y)
        a, b = a - 2 * float(g @ x) - 1e-4 * a, b - 2 * float(g.sum())
    return a / scale, b


def ruled_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict (null where no rule fits): one row for each row of ``pages``."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of("url"), "path": path_of("url")})
    return base.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "fit.rule", "fit.verdict")


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of allow by the method), method_verdict: one row for each row of ``pages``."""
    spark = pages.sparkSession
    base = ruled_urls(pages, page_id, url, rules)
    text = F.translate(F.coalesce(F.regexp_extract("url", "^(?s:.*?)://(.*)$", 1), F.lit("")), UPPER, LOWER)
    labelled = base.where("verdict is not null").select("url", text.alias("text"), "verdict")
    drawn: dict[str, list] = defaultdict(list)
    for r in drawn_by_hash(labelled, "verdict", "url", lambda n: sample, seed=seed).orderBy("h", "text", "verdict").select("text", "verdict").collect():  # 2 x sample rows at most
        drawn[r["verdict"]].append(r["text"])
    model = None
    if drawn["allow"] and drawn["block"]:
        held = {v: urls[::5] for v, urls in drawn.items()}
        first = [Markov([u for k, u in enumerate(drawn[v]) if k % 5]) for v in ("allow", "block")]
        scored = [(ratio(u, *first), int(v == "allow")) for v, urls in held.items() for u in urls]
        slope, shift = calibrated([s for s, _ in scored], [y for _, y in scored])
        model = spark.sparkContext.broadcast((Markov(drawn["allow"]), Markov(drawn["block"]), slope, shift))  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for u in b.column("text").to_pylist():
                z = model.value[2] * ratio(u, *model.value[:2]) + model.value[3] if model and u else 0.0
                out.append(1 / (1 + exp(-max(-60.0, min(60.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.float64())], [*b.schema.names[:5], "score"])

    id_type = base.schema["page_id"].dataType.simpleString()
    scored = base.select("page_id", "host", "path", "rule", "verdict", text.alias("text")).mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, score double")
    method = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score", method.alias("method_verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every url, without the model."""
    return ruled_urls(table(spark, sf_dir, "pages")).drop("url")


def _rules_sql(value: int) -> str:
    """The rules as a CASE, the longest first; value: 0 for the rule, 1 for its verdict."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in ordered) + " END"


URL_RULES_SQL = f"""SELECT page_id, host, path, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS verdict FROM (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)"""
