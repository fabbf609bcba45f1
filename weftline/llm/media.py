"""Media columns: content-defined chunks, deduplicated by digest, from which ordered chunk lists reconstruct verified media.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the frames (24 x 24 samples of 8 bits) of a binary PGM image, the
stored form. A gear hash rolls over the stored form and cuts it; each chunk has its SHA-256.

1. Digests are counted over all documents; only 40 bytes a chunk are shuffled. The digests met twice or more set bits of a filter of fixed size.
2. One pass writes the chunk table: for each document a container with the ordered list of its digests, keyed by the SHA-256 of its stored form, and in it the payloads
   of the chunks that aren't in the filter, each the only one of its digest; the others, which may be shared, go to the common store, one payload for each digest.
3. Containers are read back. Those that lack nothing are put together from their own payloads, without a shuffle. The lists of the others, those of equal media folded to
   one, are joined with the common store on the digest, and all their payloads are brought to their places. Each chunk and each whole read back is verified by SHA-256, then
   described, once for each distinct medium.
4. Documents, by the SHA-256 of the stored form that the JVM computes for them, are joined with what was read back; one whose medium isn't there is an error.

A wrong hit of the filter only sends a chunk through the common store, so results don't depend on its size. Nulls: a null text is empty and so one frame of
padding; null ids are kept. Repeated rows give repeated results; equal texts give equal values. An empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import column_bytes, discard, slices, table, written

FRAME, SIDE, PAD = 576, 24, b"\xff"
#: Chunks have at least MIN, at most MAX and about 2**CUT_BITS + MIN bytes.
MIN, MAX, CUT_BITS = 256, 16_384, 11
#: Bits of the filter of shared digests: 8 MB at any input size.
FILTER_BITS = 1 << 26
FIELDS = "doc_id {0}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(data: bytes) -> bytes:
    payload = data + PAD * (-len(data) % FRAME if data else FRAME)
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def from_media(media: bytes) -> bytes:
    kind, shape, depth, payload = media.split(b"\n", 3)
    w, h = map(int, shape.split())
    if (kind, depth) != (b"P5", b"255") or w * h != len(payload):
        raise ValueError("not a stored form of this operator")
    return payload


def gear() -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(bytes([b]), 576) for b in range(256)], np.uint32)


def cut_all(medias: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each stored form.

    The hash of 32 bits forgets what lies 32 bytes back, and no cut is taken within MIN bytes of the last, so one pass rolls over all forms at once.
    """
    joined = np.frombuffer(b"".join(medias), np.uint8)
    h, span = gear()[joined], 1
    while span < 32:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    bounds = np.searchsorted(hits, np.cumsum([0] + [len(m) for m in medias]), side="right").tolist()
    for k, m in enumerate(medias):
        ends, last = [], 0
        for x in (hits[bounds[k] : bounds[k + 1]] - at).tolist():
            while x - last > MAX:
                last += MAX
                ends.append(last)
            if x - last >= MIN:
                ends.append(last := x)
        while len(m) - last > MAX:
            last += MAX
            ends.append(last)
        if last < len(m):
            ends.append(len(m))
        out.append(ends)
        at += len(m)
    return out


def chunked(texts: list[bytes | None]):
    """For each text its stored form and its chunks (digest, bytes)."""
    medias = [to_media(t or b"") for t in texts]
    for m, ends in zip(medias, cut_all(medias)):
        chunks, a = [], 0
        for b in ends:
            piece = m[a:b]
            chunks.append((hashlib.sha256(piece).digest(), piece))
            a = b
        yield m, chunks


def described(media: bytes) -> tuple:
    """Reads a stored form back: the columns after doc_id. The feature is the average hash of the mean frame (8 x 8 blocks) and the mean sample."""
    payload = from_media(media)
    frames = np.frombuffer(payload, np.uint8).reshape(-1, 8, 3, 8, 3)
    blocks = frames.sum(axis=(0, 2, 4), dtype=np.int64).ravel()
    total = int(blocks.sum())
    bits = np.packbits(blocks * 64 > total).tobytes().hex()
    return len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{bits}-{total // len(payload):02x}"


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % FILTER_BITS


def shared_digests(docs: DataFrame) -> np.ndarray:
    """The filter's words: bits of the digests that occur twice or more."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 8 << 20):
                found = [d for _, chunks in chunked(column_bytes(b.column("text"))) for d, _ in chunks]
                yield pa.RecordBatch.from_arrays([pa.array([_bit(d) for d in found], pa.int64()), pa.array(found, pa.binary())], ["bit", "digest"])

    often = docs.select("text").mapInArrow(run, "bit long, digest binary").groupBy("digest").agg(F.first("bit").alias("bit"), F.count("*").alias("n")).where("n > 1")
    filled = often.select((F.col("bit") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    got = filled.toArrow()  # at most FILTER_BITS / 64 rows
    bits[got.column("word").to_numpy()] = got.column("b").to_numpy()
    return bits.view(np.uint64)


def chunk_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``docs(text)``, written: containers (media, digests, payloads, null where a chunk may be shared) and the common store (stored, payload)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(shared_digests(docs))  # of fixed size

    def run(batches):
        bits = shared.value
        for whole in batches:
            for b in slices(whole, 8 << 20):
                media, digests, payloads, common = [], [], [], {}
                for stored, chunks in chunked(column_bytes(b.column("text"))):
                    own = []
                    for digest, piece in chunks:
                        k = _bit(digest)
                        if (int(bits[k >> 6]) >> (k & 63)) & 1:
                            common[digest] = piece
                            piece = None
                        own.append(piece)
                    media.append(hashlib.sha256(stored).digest())
                    digests.append([d for d, _ in chunks])
                    payloads.append(own)
                media += [None] * len(common)
                digests += [[d] for d in common]
                payloads += [[p] for p in common.values()]
                yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary()))], ["media", "digests", "payloads"])

    tight = {"spark__sql__parquet__compression__codec": "zstd"}
    table = written(docs.select("text").mapInArrow(run, "media binary, digests array<binary>, payloads array<binary>"), "media-chunks", **tight)
    common = table.where("media is null").select(F.col("digests")[0].alias("stored"), F.col("payloads")[0].alias("payload"))
    return table, written(common.groupBy("stored").agg(F.first("payload").alias("payload")), "media-store", **tight)


def verified(key: bytes, digests: list[bytes], payloads: list[bytes]) -> tuple:
    """The medium that the chunks make, described; an error if a chunk or the whole isn't what its digest says."""
    if any(p is None or hashlib.sha256(p).digest() != d for d, p in zip(digests, payloads, strict=True)):
        raise ValueError("a chunk doesn't match its digest")
    media = b"".join(payloads)
    if hashlib.sha256(media).digest() != key:
        raise ValueError("a medium doesn't match its digest")
    return key, *described(media)


def read_media(table: DataFrame, store: DataFrame) -> DataFrame:
    """Each distinct medium of a chunk table, put together from its stored chunks, verified and described: media and the columns after doc_id of FIELDS."""
    import pyarrow as pa

    fields = "media binary, " + FIELDS.split(", ", 1)[1]
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def out(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    def read_whole(batches):
        for b in batches:
            yield out([verified(*row) for row in zip(*[c.to_pylist() for c in b.columns])])

    def read_placed(batches):
        held, key = [], None

        def done() -> tuple:
            if [s for s, _, _ in held] != list(range(len(held))):
                raise ValueError("a chunk list has gaps")
            return verified(key, [d for _, d, _ in held], [p for _, _, p in held])

        for b in batches:
            rows = []
            for m, *chunk in zip(*[b.column(n).to_pylist() for n in ("media", "seq", "digest", "payload")]):
                if m != key:
                    if held:
                        rows.append(done())
                    held, key = [], m
                held.append(chunk)
            yield out(rows)
        if held:
            yield out([done()])

    containers = table.where("media is not null")
    lacking = F.exists("payloads", lambda p: p.isNull())
    whole = containers.where(~lacking).select("media", "digests", "payloads").mapInArrow(read_whole, fields)
    entries = containers.where(lacking).select("media", F.posexplode(F.arrays_zip("digests", "payloads")).alias("seq", "chunk")).select("media", "seq", F.col("chunk.digests").alias("digest"), F.col("chunk.payloads").alias("payload"))
    wanted = entries.where("payload is null").select("media", "seq", "digest").distinct()
    fetched = wanted.join(store, F.col("digest") == F.col("stored")).select("media", "seq", "digest", F.col("payload"))
    placed = fetched.unionByName(entries.where("payload is not null")).repartition("media").sortWithinPartitions("media", "seq")
    return whole.unionByName(placed.mapInArrow(read_placed, fields))


def media_key(text: str) -> Column:
    """The SHA-256 of a text's stored form, without Python."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, FRAME).otherwise(F.pmod(-n, F.lit(FRAME)))
    head = F.concat(F.lit(f"P5\n{SIDE} "), ((n + pad) / SIDE).cast("long").cast("string"), F.lit("\n255\n")).cast("binary")
    return F.unhex(F.sha2(F.concat(head, data, F.unhex(F.repeat(F.lit("FF"), pad.cast("int")))), 256))


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with FIELDS, from media read back from the chunks."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chunks, store = chunk_table(docs)
    back = written(read_media(chunks, store), "media-read")
    discard(chunks, store)
    rows = docs.select("doc_id", media_key("text").alias("key")).join(back, F.col("key") == F.col("media"), "left")
    first, *rest = [f.split()[0] for f in FIELDS.split(", ")[1:]]
    return rows.select("doc_id", F.when(F.col("media").isNull(), F.raise_error(F.lit("a medium isn't in the store")).cast("long")).otherwise(F.col(first)).alias(first), *rest)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op4_media``: sizes and digests of the payloads and stored forms that were read back."""
    return op4_media(spark, sf_dir).drop("tail_crc32", "feature")


MEDIA_PAYLOADS_SQL = """WITH p AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, encode(coalesce(text, '')) || repeat('\\xFF'::BLOB, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 576 ELSE (576 - strlen(text) % 576) % 576 END) AS payload FROM documents),
m AS (SELECT doc_id, n, payload, encode('P5' || chr(10) || '24 ' || octet_length(payload) // 24 || chr(10) || '255' || chr(10)) || payload AS media FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256 FROM m"""
