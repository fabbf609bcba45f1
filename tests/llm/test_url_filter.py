import math
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import url_filter

URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://b.www.Example.com/en/q?x#y", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "ftp://com", "http://a.com?x", "http://a.org/en/", None, "no scheme.com/x", "http://h.net/de/?a=://b.com/", "", "http://m.example.com/en/5"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == (verdict or got[k].method_verdict)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = url_filter.op9_url_filter(spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    labelled = [(r.method_verdict == r.verdict) for r in rows if r.rule]
    assert sum(labelled) > 0.9 * len(labelled)


def test_markov_like_brute_force():
    urls = ["a.com/en/1", "a.com/de/2", "b.net/"]
    m = url_filter.Markov(urls, 2)
    counts = [Counter() for _ in range(3)]
    for u in urls:
        t = "\n\n" + u + "\n"
        for i in range(2, len(t)):
            for k in range(3):
                counts[k][t[i - k : i], t[i]] += 1

    def p(context, c):
        out = 1 / 256
        for k in range(len(context) + 1):
            ctx = context[len(context) - k :]
            own = {s: n for (x, s), n in counts[k].items() if x == ctx}
            if not own:
                break
            out = (own.get(c, 0) + len(own) * out) / (sum(own.values()) + len(own))
        return out

    for u in ("a.com/fr/", "", "zzz"):
        t = "\n\n" + u + "\n"
        assert math.isclose(m.log(u), sum(math.log(p(t[i - 2 : i], t[i])) for i in range(2, len(t))))
    assert math.isclose(sum(m.probability("a." + chr(c)) for c in range(256)), 1.0)


def test_one_kind_of_label_allows(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/"), (2, "http://a.org/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(df).collect()} == {"allow"}


def test_copies_dont_starve_a_verdict(spark):
    hot = [(0, "http://example.com/en/hot")] * 5000
    rest = [(k, f"http://example.com/en/spam-{k}") for k in range(1, 60)] + [(k, f"http://a.com/page-{k}") for k in range(100, 160)] + [(900, "http://b.org/page-7")]
    df = spark.createDataFrame(hot + rest, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, sample=50).collect()}
    assert got[900].score != 0.5 and all(got[k].method_verdict == "block" for k in range(1, 60)) and all(got[k].method_verdict == "allow" for k in range(100, 160))
