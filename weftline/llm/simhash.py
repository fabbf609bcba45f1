"""SimHash near-dedup by the generalised pigeonhole principle.

Texts are lower-cased in A-Z, cut into words and three-word shingles (repeats included), and hashed to a 64-bit fingerprint. Fingerprints that
differ in at most ``distance`` bits are linked. Search works on distinct fingerprints:

1. bit co-occurrences over all of them group correlated bits into ``parts`` (2 or 4) partitions of 64 / parts bits each;
2. value counts of 16-bit blocks, at most 4 x 65,536 numbers whatever the input, estimate for each fingerprint, partition and threshold how many
   fingerprints lie within the threshold there;
3. for each fingerprint dynamic programming allots thresholds, -1 (not probed) or more, that sum to distance - parts + 1 at the least estimated
   cost. By the generalised pigeonhole principle any fingerprint within ``distance`` is within the threshold of some partition;
4. each fingerprint probes its variants within the thresholds against an index of exact partition values by an equi-join, and the full
   distance of each candidate is verified in the join. Copies are folded before, so hot groups of copies are one row.

Nulls: a null text and a text without words have fingerprint zero, linked like any other; a null id is never a component id unless all of the
component's ids are null. Repeated rows and ids are allowed: each row gets a result. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from weftline.llm.common import LOWER_ASCII, WORD_BYTES, column_bytes, discard, slices, table, written
from weftline.llm.components import connected_components

BITS, DISTANCE, PARTS, SHINGLE, SEED = 64, 3, 2, 3, 42
#: One probe row costs about as much as this many verified candidates.
PROBE_COST = 4.0


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    tokens = WORD_BYTES.findall((text or b"").translate(LOWER_ASCII))
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(tokens) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    ones, n, held = np.zeros(BITS, np.int64), 0, []
    for a, b in spans:
        held.append(xxh64_intdigest(joined[a:b], seed))
        if len(held) == 1 << 16:  # memory stays bounded for very long texts
            ones += np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n, held = n + len(held), []
    if held:
        ones += np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(held)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: Column | None = None) -> DataFrame:
    """doc_id and fp (signed 64 bits), one row for each row; ``also``, a string of the row, adds the column digest."""
    digest = [] if also is None else [also.alias("digest")]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *digest)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 16 << 20):
                fps = pa.array([fingerprint(t) for t in column_bytes(b.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps, *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long" + ", digest string" * len(digest))


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both set: 4,096 sums over all of them."""

    def run(batches):
        import pyarrow as pa

        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel().round().astype(np.int64), n))], ["pair", "n"])

    found = distinct.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1, np.int64)
    for r in found:
        sums[r["pair"]] = r["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def bit_layout(n: int, both: np.ndarray, parts: int = PARTS) -> list[int]:
    """The bits in their new order: partition after partition, each grown from its strongest pair by the mean absolute correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, order = list(range(BITS)), []
    for _ in range(parts):
        sub = tied[np.ix_(left, left)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape) if len(left) > 1 else (0, 0)
        group = [left[i], left[j]] if i != j else left[:2]
        while len(group) < BITS // parts:
            rest = [x for x in left if x not in group]
            group.append(rest[int(tied[np.ix_(rest, group)].mean(1).argmax())])
        order += group
        left = [x for x in left if x not in group]
    return order


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.uint64)
    for to, at in enumerate(order):
        out |= ((u >> np.uint64(at)) & np.uint64(1)) << np.uint64(to)
    return out.view(np.int64)


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], np.uint64)


def near_counts(counts: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """counts of 16-bit values to [distance, value]: how many lie at exactly that distance."""
    values = np.arange(1 << 16, dtype=np.int64)
    return np.stack([sum(counts[values ^ sum(1 << b for b in bits)] for bits in combinations(range(16), r)).astype(np.float64) for r in range(distance + 1)])


def allotments(g: np.ndarray, near: np.ndarray, n: int, parts: int = PARTS, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the thresholds of the partitions, by dynamic programming over the estimated costs."""
    per, width, most = 4 // parts, BITS // parts, distance + 1
    sizes = np.array([0] + [len(ball(width, t)) for t in range(most)], np.float64)
    cost = np.zeros((parts, most + 1, len(g)))
    for p in range(parts):
        dist = None
        for k in range(per):  # blocks of a partition count as independent
            value = (g.view(np.uint64) >> np.uint64(16 * (p * per + k))) & np.uint64(0xFFFF)
            own = near[p * per + k][:, value.astype(np.int64)]
            dist = own if dist is None else np.stack([sum(dist[a] * own[t - a] for a in range(t + 1)) / max(n, 1) for t in range(most)])
        cost[p, 1:] = np.cumsum(dist, axis=0) + PROBE_COST * sizes[1:, None]
    total = distance + 1  # thresholds plus one each sum to distance - parts + 1 + parts
    best = np.full((parts + 1, total + 1, len(g)), np.inf)
    pick = np.zeros((parts + 1, total + 1, len(g)), np.int8)
    best[0, 0] = 0
    for p in range(parts):
        for t in range(total + 1):
            for own in range(min(t, most) + 1):
                c = best[p, t - own] + cost[p, own]
                better = c < best[p + 1, t]
                best[p + 1, t][better] = c[better]
                pick[p + 1, t][better] = own
    out, t, rows = np.zeros((len(g), parts), np.int8), np.full(len(g), total), np.arange(len(g))
    for p in range(parts, 0, -1):
        own = pick[p, t, rows]
        out[:, p - 1] = own - 1
        t = t - own
    return out


def links(fps: DataFrame, near: np.ndarray, n: int, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """``fps(g)``, distinct, to the pairs (a, b) within the distance."""
    width = BITS // parts
    low = np.uint64((1 << width) - 1)
    shared = fps.sparkSession.sparkContext.broadcast(near.astype(np.float32))  # 4 x (distance + 1) x 65,536 numbers at any input size

    def probe(batches):
        import pyarrow as pa

        balls = [ball(width, t) for t in range(distance + 1)]
        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            given = allotments(g, shared.value, n, parts, distance)
            for p in range(parts):
                value = (g.view(np.uint64) >> np.uint64(width * p)) & low
                for t in range(distance + 1):
                    own = np.flatnonzero(given[:, p] == t)
                    step = max(1, 200_000 // len(balls[t]))
                    for k in range(0, len(own), step):
                        rows = own[k : k + step]
                        keys = (value[rows][:, None] ^ balls[t][None, :]).ravel() | np.uint64(p << width)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(g[rows], len(balls[t])))], ["key", "g"])

    probes = fps.select("g").mapInArrow(probe, "key long, g long")
    values = [F.shiftrightunsigned("g", width * p).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(p << width)) for p in range(parts)]
    index = fps.select(F.explode(F.array(*values)).alias("k"), F.col("g").alias("h"))
    pairs = probes.join(index, (F.col("key") == F.col("k")) & (F.col("g") < F.col("h")) & (F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= distance))
    return pairs.select(F.col("g").alias("a"), F.col("h").alias("b"))


def named_components(prints: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """``prints(doc_id, fp, ...)`` to f (each distinct fingerprint), component_id (the smallest id of its component) and part, a number that no other
    component has, whatever the ids."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    n, both = bit_counts(distinct)
    order = bit_layout(n, both, parts)
    id_type = prints.schema["doc_id"].dataType.simpleString()

    def permute(batches):
        import pyarrow as pa

        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(permuted(fp, order)), b.column(1)], ["fp", "g", "rep"])

    fps = written(distinct.select("fp", "rep").mapInArrow(permute, f"fp long, g long, rep {id_type}"), "simhash-distinct")
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("g", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("value")) for k in range(4)]
    counts = np.zeros((4, 1 << 16))
    for r in fps.select(F.explode(F.array(*blocks)).alias("x")).groupBy("x.block", "x.value").count().toLocalIterator():
        counts[r[0], r[1]] = r[2]
    near = np.stack([near_counts(c, distance) for c in counts])

    found = connected_components(links(fps, near, n, parts, distance))
    members = fps.join(found, F.col("g") == F.col("node")).select("fp", "rep", "component")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    named = members.join(least, "component").select(F.col("fp").alias("fp2"), "least", "component")
    named = fps.join(named, F.col("fp") == F.col("fp2"), "left")
    # components are named by the least of their permuted fingerprints, one without links by its own
    named = named.select(F.col("fp").alias("f"), F.when(F.col("fp2").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "g").alias("part"))
    named = written(named, "simhash-named")  # with a plain exchange on both sides a fingerprint of many copies is split
    discard(fps, found)
    return named


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id of the component): one row for each row of ``docs``."""
    prints = written(fingerprints(docs, doc_id, text), "simhash-fps")
    named = named_components(prints, parts, distance)
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """One document of each component with all its columns: the one of its smallest id, a null id last, and of its texts of that id the one of the least
    hash; of rows that agree in both the least by the columns that have an order stays. An id that stands in several components is a document in each. What stays is
    chosen by id and hash; then the rows, packed so that no column's name matters, are shuffled once."""
    identity = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("null"))
    key = F.md5(F.concat_ws(":", identity, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    prints = written(fingerprints(docs, doc_id, text, also=key), "simhash-fps")
    named = named_components(prints, parts, distance)
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("row"))
    best = best.join(named, F.col("fp") == F.col("f")).groupBy("part").agg(F.min("row").alias("row"))
    chosen = written(best.select(F.col("row.digest").alias("key")), "simhash-kept")
    discard(prints, named)
    # a null text and an empty one share a fingerprint, and so a component
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(chosen.hint("merge"), "key", "left_semi")
    ordered = [f"row.`{f.name}`" for f in docs.schema.fields if _has_order(f.dataType)]
    least = F.min("row") if len(ordered) == len(docs.columns) else F.min_by("row", F.struct(*ordered))
    return rows.groupBy("key").agg(least.alias("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def _has_order(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    return _has_order(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
