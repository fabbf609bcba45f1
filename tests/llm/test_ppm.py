import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import ppm


def plain(train, texts, order=ppm.ORDER):
    """Token counts and scores of each text by a dictionary of contexts."""
    counts, contexts = Counter(), [defaultdict(Counter) for _ in range(order + 1)]

    def line(t):
        return b"\n" * order + b" ".join(ppm.tokens_of(t)) + b"\n"

    for t in train:
        counts.update(ppm.tokens_of(t))
        counts[b"\n"] += 1
        s = line(t)
        for p in range(order, len(s)):
            for k in range(order + 1):
                contexts[k][s[p - k : p]][s[p]] += 1
    total, kinds = sum(counts.values()), len(counts)

    def probability(s, p):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            found = {x: n for x, n in contexts[k].get(s[p - k : p], {}).items() if x not in gone}
            if not found:
                continue
            t = sum(found.values())
            if s[p] in found:
                return out + math.log10((2 * found[s[p]] - 1) / (2 * t))
            out += math.log10(len(found) / (2 * t))
            gone |= set(found)
        return out - math.log10(256 - len(contexts[0].get(b"", {})))

    rows = []
    for t in texts:
        tokens = [*ppm.tokens_of(t), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        s = line(t)
        rows.append((len(tokens), sum(counts[w] > 0 for w in tokens), total, base, sum(probability(s, p) for p in range(order, len(s)))))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("block_bytes", [1 << 25, 40_000])
def test_like_brute_force(spark, sf_dir, texts, block_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in ppm.score_documents(docs, block_bytes=block_bytes).collect()}
    some = sorted(texts)[:40]
    want = plain([t.encode() for i, t in texts.items() if not held(i)], [texts[i].encode() for i in some])
    assert len(got) == len(texts)
    for i, w in zip(some, want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), *w[:3])
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9)


def test_probabilities_sum_to_one():
    train = [b"abracadabra", b"abba cab", b""]
    code = np.concatenate([ppm.grams_of([ppm.tokens_of(t)])[0] for t in train])
    context = ppm.grams_of([[b"abrac"]])[0][5] >> np.uint64(8) << np.uint64(8)
    for base in (context, np.uint64(0x0A0A0A0A0A00), np.uint64(0x7A7A7A7A7A00)):
        asked = base | np.arange(256, dtype=np.uint64)
        grams, n = ppm.summed(np.concatenate([code, asked]), np.concatenate([np.ones(len(code), np.int64), np.zeros(256, np.int64)]))
        score = ppm.score_grams(grams, n, ppm.orders_of(code, np.ones(len(code), np.int64), 0, ppm.BASE - 1))
        assert math.isclose(sum(10 ** score[np.searchsorted(grams, asked)]), 1.0, rel_tol=1e-9)


def test_finder():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    find = ppm.Finder(keys[::2])
    assert (find(keys[::2]) == np.arange(len(keys[::2]))).all() and (find(keys[1::2]) == -1).all()
    assert (ppm.Finder(keys[:0])(keys[:5]) == -1).all()


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "A a"), (3, "A a"), (None, "b"), (4, "long text " * 20_000), (5, "\x00 é")]
    got = ppm.score_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 1 and by[1].score == by[2].score and by[4].n_tokens == 40_001 and by[None].held_out is False
    assert ppm.score_documents(make_docs(rows).limit(0)).count() == 0
    only_held = [(i, "x y") for i in range(200) if held(i)][:3]
    got = ppm.score_documents(make_docs(only_held)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and math.isclose(r.score, -4 * math.log10(256)) for r in got)


def test_groups_are_scored_whole_whatever_the_slices():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    code, n = ppm.summed(ppm.grams_of([[bytes(rng.integers(97, 101, 9).astype(np.uint8)) for _ in range(3000)]])[0], np.ones(30_000, np.int64))
    low = ppm.orders_of(code, n, 0, ppm.BASE - 1)
    want = dict(zip(code.tolist(), ppm.score_grams(code, n, low)))
    order = np.argsort(ppm.Contexts.masked(code, ppm.BASE) >> np.uint64(8), kind="stable")
    key, n = code[order].view(np.int64), n[order]
    for rows, most in ((7, 10), (100, 1000), (100_000, 10)):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + rows]), pa.array(n[a : a + rows])], ["key", "n"]) for a in range(0, len(key), rows)]
        got = {int(k): v for keys, values in ppm.scored_groups(batches, low, most=most) for k, v in zip(keys, values)}
        assert got == pytest.approx(want)
    assert list(ppm.scored_groups([], low)) == []


def test_repeated_rows_of_a_file_spread(spark, tmp_path):
    rows = [(None, "the same text")] * 400 + [(7, "another text")] * 400
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = ppm.score_documents(docs, block_bytes=500)
    assert got.count() == 800 and got.select("doc_id", "score").distinct().count() == 2
    from pyspark.sql import functions as F

    from weftline.llm.common import place_in_file

    dealt = place_in_file(docs, lambda p: [F.pmod(F.xxhash64("doc_id", "text", p), F.lit(10)).alias("b")]).groupBy("b").count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 160
