import numpy as np
from pyspark.sql import functions as F

from weftline.llm import mixing
from weftline.llm.common import words


def levels(sizes):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, slack):
    sizes, taken, target = {}, {}, {}
    for source, r in rows:
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = levels(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= slack


def with_sources(docs, df):
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    return [(source[r.doc_id], r) for r in df.collect()]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mixing.op3_mixing(spark, sf_dir)
    check(with_sources(docs, first), 2 * mixing.BLOCK)
    assert sorted(first.collect()) == sorted(mixing.op3_mixing(spark, sf_dir).collect())


def test_caps_reshare_over_several_rounds(make_docs):
    rows = [(1, "w " * 50, "a"), (2, "w " * 3000, "b"), (3, "w " * 400, "c"), (4, "w " * 40_000, "d"), (5, "w " * 9000, None), (6, "", "e"), (7, None, "f"), (8, "w " * 700, "c")]
    docs = make_docs(rows)
    check(with_sources(docs, mixing.mix_sources(docs)), mixing.BLOCK)
    check(with_sources(docs, mixing.mix_sources(docs, shard_tokens=5000)), 8 * mixing.BLOCK)


def test_edges(make_docs):
    assert mixing.mix_sources(make_docs([]).limit(0)).count() == 0
    got = mixing.mix_sources(make_docs([(1, None), (2, " ")])).collect()
    assert {(r.size, r.taken, r.target) for r in got} == {(0, 0, 0.0)}
    same = mixing.mix_sources(make_docs([(1, "a b c " * 200)] * 5)).collect()
    assert len(same) == 5 and sum(r.taken for r in same) == 5 * 600 - (5 * 600) % mixing.BLOCK or abs(sum(r.taken for r in same) - 3000) <= mixing.BLOCK


def test_the_mix_itself_holds_what_was_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix_sources(docs).where("taken > 0").collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.size(words("text"))).alias("n")).collect()}
    assert got == want


def highest_quotients(targets, total, block):
    """One seat after another to the highest target / (2k + 1); targets: (source, size, target, rank). The last seat and a source's last are cut."""
    seats = {t[0]: 0 for t in targets}
    got = dict.fromkeys(seats, 0)
    for seat in range(-(-total // block)):
        free = [t for t in targets if t[2] > 0 and seats[t[0]] * block < 3 * t[1]]
        if not free:
            break
        best = max(free, key=lambda t: (t[2] / (2 * seats[t[0]] + 1), -t[3]))
        got[best[0]] += min(block, 3 * best[1] - seats[best[0]] * block, total - seat * block)
        seats[best[0]] += 1
    return got


def test_seats_go_to_the_highest_quotients(spark):
    rng = np.random.default_rng(3)
    cases = [[(f"s{k:03}", 90, 90.0 / 128 * 77, k) for k in range(300)] + [("z", 10**5, 10.0**5, 300)]]
    for n in (1, 7, 60):
        size = rng.integers(0, 3000, n).tolist()
        want = levels({f"s{k:03}": v for k, v in enumerate(size)})
        cases.append([(f"s{k:03}", v, want[f"s{k:03}"], k) for k, v in enumerate(size)])
    cases.append([(f"s{k:03}", 500, 500.0, k) for k in range(40)])  # ties
    for case in cases:
        total = int(sum(t[1] for t in case))
        df = spark.createDataFrame(case, "source string, source_size long, target double, rank long")
        for block in (128, 5):
            got = {r.source: r.words for r in mixing.source_words(df, total, block).collect()}
            assert {**{t[0]: 0 for t in case}, **got} == highest_quotients(case, total, block)


def test_thin_sources_come_near_their_targets(make_docs):
    docs = make_docs([(k, "w " * 1250, "a") for k in range(200)] + [(1000 + k, "w " * 20, "b") for k in range(100)])
    rows = with_sources(docs, mixing.mix_sources(docs, shard_tokens=20_000))
    check(rows, 2 * mixing.BLOCK)
    assert sum(r["taken"] for s, r in rows if s == "b") == 3 * 100 * 20


def test_every_row_is_planned_by_itself(spark):
    rows = [(None, f"n{k} " * 40, "a", "mine", 5) for k in range(60)] + [(None, "same words here " * 30, "a", "mine", 5)] * 3 + [(7, f"seven {k} " * 50, "b", "mine", 5) for k in range(20)] + [(8, None, "b", "mine", 5), (9, "", None, "mine", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, row int")
    mixed = mixing.mixed_documents(docs, shard_tokens=1000)
    assert mixed.columns == docs.columns and mixed.where("_size <> 'mine' or row <> 5").count() == 0
    planned = {r.source: r.n for r in mixing.plan_mix(docs, shard_tokens=1000).groupBy("source").agg(F.sum(F.col("size") * F.col("passes") + F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])).alias("n")).collect()}
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(words("text"))).alias("n")).collect()}
    assert got == {s: n for s, n in planned.items() if n}
