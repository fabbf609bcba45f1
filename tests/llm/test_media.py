import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import media


def plain(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    stored = media.to_media(data)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest()


def plain_feature(text):
    """By loops over samples: which of 8 x 8 fields of the mean frame are above the mean, and the mean sample."""
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    fields = [0] * 64
    for k, v in enumerate(payload):
        row, column = divmod(k % 576, 24)
        fields[row // 3 * 8 + column // 3] += v
    bits = "".join("1" if f * 64 > sum(fields) else "0" for f in fields)
    return f"{int(bits, 2):016x}-{sum(fields) // len(payload):02x}"


def found(r):
    return r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256


def test_whole_table(spark, sf_dir, texts):
    rows = media.op4_media(spark, sf_dir).collect()
    assert {r.doc_id: found(r) for r in rows} == {i: plain(t) for i, t in texts.items()} and len(rows) == len(texts)
    assert {r.doc_id: r.feature for r in rows} == {i: plain_feature(t) for i, t in texts.items()}


def test_edges_and_shared_chunks(make_docs):
    rng = np.random.default_rng(3)
    long = "".join(chr(97 + k) for k in rng.integers(0, 26, 60_000))
    rows = [(1, None), (2, ""), (3, "x"), (4, "y" * 576), (5, "z" * 577), (6, long), (7, long), (7, long), (8, "intro " + long), (9, long + "é"), (None, long), (10, "0" * 50_000)]
    got = media.media_columns(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    assert all(found(r) == plain(want[r.doc_id]) for r in got)
    assert media.media_columns(make_docs(rows).limit(0)).count() == 0


def test_cuts_follow_the_content():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 255, 80_000, dtype=np.uint8).tobytes()
    one, two = media.cut_all([a, b"some bytes before" + a])
    assert one[-1] == len(a) and max(np.diff([0, *one])) <= media.MAX and min(np.diff([0, *one[:-1]])) >= media.MIN
    assert len({x + 17 for x in one} & set(two)) > 0.8 * len(one)
    assert media.cut_all([b"", b"ab"]) == [[], [2]]
    assert media.cut_all([a])[0] == one


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        media.from_media(media.to_media(b"abc")[:-1])
    assert media.from_media(media.to_media(b"abc")).rstrip(b"\xff") == b"abc"


def test_every_document_is_read_from_the_store(spark, make_docs):
    rng = np.random.default_rng(8)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, 9_000)) for _ in range(4)]
    docs = make_docs([(k, texts[k]) for k in range(4)] + [(9, texts[0]), (9, texts[0]), (10, texts[1] + texts[2]), (11, None)])
    chunks, store = media.chunk_table(docs)
    assert media.read_media(chunks, store).count() == 6
    own = chunks.withColumn("payloads", F.when(F.col("media").isNotNull(), F.transform("payloads", lambda p: F.when(F.md5(p) < "8", F.encode(F.hex(p), "utf-8")).otherwise(p))).otherwise(F.col("payloads")))
    for table, common in ((own, store), (chunks, store.withColumn("payload", F.encode(F.hex("payload"), "utf-8")))):
        with pytest.raises(Exception, match="a chunk doesn't match its digest"):
            media.read_media(table, common).collect()
    with pytest.raises(Exception, match="a chunk list has gaps|a medium doesn't match its digest"):
        media.read_media(chunks, store.where("md5(stored) < '8'")).collect()
    short = chunks.selectExpr("media", "slice(digests, 1, size(digests) - 1) as digests", "slice(payloads, 1, size(payloads) - 1) as payloads").where("media is not null")
    with pytest.raises(Exception, match="a medium doesn't match its digest"):
        media.read_media(short, store).collect()
    assert sorted(r.k for r in docs.select(media.media_key("text").alias("k")).distinct().collect()) == sorted(hashlib.sha256(media.to_media((t or "").encode())).digest() for t in {r.text for r in docs.collect()})
