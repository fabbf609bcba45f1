import numpy as np
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_whole_table_like_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    parts = plain_components(prints)
    assert got == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_edges(make_docs):
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long), (8, long), (None, "alone in here now")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(make_docs(rows)).collect()]
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[5] == (f"{xxhash.xxh64_intdigest(b'one', 42):016x}", 4)
    assert by[8][1] == 7 and by[7][0] == f"{plain_fingerprint(long):016x}" and by[None][1] is None
    assert simhash.near_dedup(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [2, 4])
def test_links_of_random_and_dense_fingerprints(spark, parts):
    rng = np.random.default_rng(parts)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ sum((np.uint64(1) << np.uint64(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)), np.uint64(0)) for b in base for _ in range(4)]
    all_fp = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(40, dtype=np.uint64)]))
    want = {(int(a), int(b)) for a in all_fp.view(np.int64) for b in all_fp.view(np.int64) if a < b and bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 3}
    fps = spark.createDataFrame([(int(x),) for x in all_fp.view(np.int64)], "g long")
    counts = np.stack([np.bincount(((all_fp >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) for k in range(4)])
    near_counts = np.stack([simhash.near_counts(c) for c in counts])
    got = {(r.a, r.b) for r in simhash.links(fps, near_counts, len(all_fp), parts).collect()}
    assert got == want


def test_thresholds_sum_as_the_pigeonhole_asks():
    g = np.arange(500, dtype=np.int64) * 7919
    counts = np.zeros((4, 1 << 16))
    counts[0, : 1 << 10] = 5000  # a hot block
    near = np.stack([simhash.near_counts(c) for c in counts])
    for parts in (2, 4):
        t = simhash.allotments(g, near, 5_000_000, parts)
        assert (t.sum(1) == 3 - parts + 1).all() and t.min() >= -1


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(0, 20, 2):
        bits[:, 63 - k] = bits[:, k]  # pairs far apart
    order = simhash.bit_layout(len(bits), (bits.T @ bits).astype(float), 2)
    assert sorted(order) == list(range(64))
    side = {b: k // 32 for k, b in enumerate(order)}
    assert all(side[63 - k] == side[k] for k in range(0, 20, 2))


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5), (None, 3), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(make_docs):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "quite another text here"), (2, "quite another text here")]
    assert sorted(r.doc_id for r in simhash.keep_one_each(make_docs(rows)).collect()) == [1, 2]


def test_one_of_each_stays_whatever_the_ids(make_docs):
    one, near, other, third = "a b c d e", "A b c d e", "quite another text here", "and a third one of words"
    rows = [(None, one), (None, near), (None, other), (7, third), (7, "text of its own, seven"), (8, "text of its own, seven"), (9, other), (None, None), (5, "7 7 7 7 7")]
    got = sorted((str(r.doc_id), r.text.lower() if r.text else None) for r in simhash.keep_one_each(make_docs(rows)).collect() if r.text)
    assert got == sorted([("None", one), ("9", other), ("7", third), ("7", "text of its own, seven"), ("5", "7 7 7 7 7")])
    assert simhash.keep_one_each(make_docs(rows)).where("text is null").count() == 1


def test_one_of_each_ignores_ids_that_name_other_components(make_docs):
    rows = [(1, "the first group of words"), (2, "the first group of words"), (2, "a second group, with others"), (1, "a second group, with others")]
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one_each(make_docs(rows)).collect())
    assert got == [(1, "a second group, with others"), (1, "the first group of words")]


def test_one_of_each_keeps_all_columns_whatever_their_names(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a b c d', map('k', 1), 'x', 'p'), (2, 'a b c d', map('k', 2), 'y', 'q'), (3, 'e f g h i', map(), 'z', 'r'), (3, 'e f g h i', map(), 'z', 'r')
        t(doc_id, text, _kept, _md5, key)""")
    got = simhash.keep_one_each(df)
    assert got.columns == df.columns and sorted((r.doc_id, r._kept, r._md5, r.key) for r in got.collect()) == [(1, {"k": 1}, "x", "p"), (3, {}, "z", "r")]


def test_a_cluster_needs_a_shared_folder(spark):
    from weftline.llm.common import shared_dir

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert "weftline" in shared_dir(Session) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
