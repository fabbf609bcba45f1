"""LM scoring by prediction by partial matching.

A text is its lower-cased words, one space between, and an end. The model is a byte-context trie of orders 0 to ``ORDER`` over all training texts,
pretrained: in a context with T (non-excluded) symbols of q kinds a symbol seen n times has (2n - 1) / 2T, the escape q / 2T; on an escape the symbols of
the longer context are excluded from the shorter one; the last resort is uniform over bytes not yet excluded. A text's score is the sum of the log10
probabilities of its bytes and its end.

The trie is never in one place. Documents are dealt into blocks of about ``BLOCK_BYTES`` by hash of id, text and place in their file, so copies and repeated
rows spread; each block gives its distinct grams (a symbol and its ORDER bytes of context, packed in 64 bits) and words with their training counts. Counts are summed
by gram over all blocks; grams that share their last three context bytes, at most 2^24, are scored together, a few such groups at a time, and the lower orders come from a broadcast table of three-byte
counts, at most 2^24 whatever the input. Joins bring each block the values of its own grams and words, and only those, sorted before its texts, which stream past them.
Everything else follows the input and no table is broadcast that does.

Nulls: a null text is empty and so one end; a null id is held in. Repeated rows get repeated results; each counts in training. Without training
texts every byte has 1/256. An empty table gives an empty result. Words are counted by a 64-bit hash. Other columns aren't read. Rows that don't come straight from
files are written first, as only then their places are the same in both passes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_ASCII, WORD_BYTES, column_bytes, discard, from_files, give_back, place_in_file, remainder, table, written

ORDER, BLOCK_BYTES, SLICE_BYTES = 5, 24 << 20, 2 << 20
#: Context bytes that grams share which are scored together, and how many grams are scored at once if their groups aren't larger.
BASE, SLICE_GRAMS = 3, 400_000
#: Rows go to Python so many at a time, as the JVM's buffers are as large as a batch; intermediate tables are packed more tightly.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "5000", "spark__sql__execution__arrow__maxBytesPerBatch": str(8 << 20), "spark__sql__parquet__compression__codec": "zstd"}
END = b"\n"
WORD, GRAM = 0, 1


def tokens_of(text: bytes | None) -> list[bytes]:
    return WORD_BYTES.findall((text or b"").translate(LOWER_ASCII))


def grams_of(docs: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of all bytes and ends of the documents, the symbol in the lowest byte, and each document's number of them.

    Before its first byte a document has ends as context.
    """
    parts = [END * order + b" ".join(ws) + END for ws in docs]
    sizes = np.array([len(p) for p in parts], np.int64)
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    code = b.copy()
    for j in range(1, order + 1):
        code[j:] |= b[:-j] << np.uint64(8 * j)
    own = np.ones(len(b), bool)
    starts = np.cumsum(sizes) - sizes
    for j in range(order):
        own[starts + j] = False
    return code[own], sizes - order


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Finder:
    """Places of keys in a sorted array of distinct keys, by open addressing; about as fast as memory."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            wrong = self.table[at] != left
            left, at = left[wrong], (at[wrong] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for keys that aren't there."""
        at = self._slot(keys)
        out = self.table[at]
        rows = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        at = at[rows]
        while len(rows):
            at = (at + 1) & self.mask
            new = self.table[at]
            out[rows] = new
            more = (new >= 0) & (self.keys[new] != keys[rows])
            rows, at = rows[more], at[more]
        return out


def parts_of(texts, most: int = SLICE_BYTES):
    """The words of a column of texts (Arrow, or a list of bytes) in parts of about ``most`` bytes, with the index of each part's first text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pa.chunked_array([pa.array(texts, pa.binary())]) if isinstance(texts, list) else texts
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        part_column = column.slice(a, b - a)
        yield a, [tokens_of(t) for t in (part_column.to_pylist() if pa.types.is_binary(column.type) else column_bytes(part_column))]


def word_keys(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, an end behind each document, and each document's number of them."""
    from xxhash import xxh64_intdigest

    sizes = np.array([len(ws) + 1 for ws in docs], np.int64)
    out = np.empty(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes) - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own] = np.fromiter((xxh64_intdigest(w) for ws in docs for w in ws), np.uint64, len(out) - len(docs))
    out[ends] = xxh64_intdigest(END)
    return out, sizes


def with_counts(keys: np.ndarray, train: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their training counts, added to those held so far."""
    kept, n = np.unique(keys[train], return_counts=True)
    others = np.unique(keys[~train])
    return summed(np.concatenate([held[0], kept, others]), np.concatenate([held[1], n, np.zeros(len(others), np.int64)]))


class BlockKeys:
    """The distinct words and grams of a block with their training counts, gathered slice by slice."""

    def __init__(self, order: int = ORDER):
        self.order, self.words, self.grams = order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, texts: list[bytes | None], train: list[bool]) -> None:
        for first, docs in parts_of(texts):
            own = np.array(train[first : first + len(docs)], bool)
            keys, sizes = word_keys(docs)
            self.words = with_counts(keys, np.repeat(own, sizes), self.words)
            code, sizes = grams_of(docs, self.order)
            self.grams = with_counts(code, np.repeat(own, sizes), self.grams)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kind, key and training count."""
        kind = np.repeat(np.array([WORD, GRAM], np.int8), [len(self.words[0]), len(self.grams[0])])
        return kind, np.concatenate([self.words[0], self.grams[0]]).view(np.int64), np.concatenate([self.words[1], self.grams[1]])


def runs_of(batches, column: str):
    """(value, slice) of the runs of equal values in an integer column of Arrow batches."""
    for b in batches:
        values = b.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield int(values[x]), b.slice(x, y - x)


class Buffer:
    """Rows held until their texts have about ``SLICE_BYTES``."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, texts: list[bytes | None], *columns: list) -> bool:
        self.rows += zip(texts, *columns)
        self.size += sum(len(t) for t in texts if t)
        return self.size >= SLICE_BYTES

    def take(self) -> list[list]:
        out = [list(c) for c in zip(*self.rows)]
        self.rows, self.size = [], 0
        return out


class Contexts:
    """The counts of one order: sorted grams, and their contexts with totals and kinds."""

    def __init__(self, order: int, keys: np.ndarray, sums: np.ndarray, lower: Contexts | None = None):
        self.order, self.keys, self.sums = order, keys, sums.astype(np.float64)
        self.contexts, self.at = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.kinds = np.bincount(self.at, minlength=len(self.contexts)).astype(np.float64)
        self.totals = np.bincount(self.at, weights=self.sums, minlength=len(self.contexts))
        # what the symbols of each context weigh in the next lower order
        self.mass = np.bincount(self.at, weights=lower.count(keys), minlength=len(self.contexts)) if lower else np.zeros(len(self.contexts))

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.zeros(len(wanted))
        i = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[i] == wanted, values[i], 0.0)

    @staticmethod
    def masked(grams: np.ndarray, order: int) -> np.ndarray:
        return grams & np.uint64((1 << (8 * (order + 1))) - 1)

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Of grams, longer ones included."""
        return self._find(self.keys, self.masked(grams, self.order), self.sums)

    def of_context(self, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self._find(self.contexts, self.masked(grams, self.order) >> np.uint64(8), values)


def orders_of(grams: np.ndarray, n: np.ndarray, first: int, last: int, lower: Contexts | None = None) -> dict[int, Contexts]:
    """The counts of the orders ``first`` to ``last`` from grams of order ``last`` or more with their training counts."""
    found = {}
    for k in range(first, last + 1):
        keys, sums = summed(Contexts.masked(grams[n > 0], k), n[n > 0])
        lower = found[k] = Contexts(k, keys, sums, lower)
    return found


def score_grams(grams: np.ndarray, n: np.ndarray, low: dict[int, Contexts], order: int = ORDER, base: int = BASE) -> np.ndarray:
    """log10 probability of each gram.

    grams: distinct; together all that share the last ``base`` context bytes with any of them. n: their training counts. low: the counts of the orders below
    ``base`` over the whole corpus.
    """
    orders = low | orders_of(grams, n, base, order, low[base - 1])
    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for k in range(order, -1, -1):
        g = grams[left]
        own = orders[k]
        count, total, kinds = own.count(g), own.of_context(g, own.totals), own.of_context(g, own.kinds)
        if k < order:
            longer = orders[k + 1]
            total, kinds = total - longer.of_context(g, longer.mass), kinds - longer.of_context(g, longer.kinds)
        hit = (count > 0) & (total > 0)
        out[left[hit]] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
        escapes = ~hit & (total > 0)
        out[left[escapes]] += np.log10(kinds[escapes] / (2 * total[escapes]))
        left = left[~hit]
    out[left] -= math.log10(max(1, 256 - len(orders[0].keys)))
    return out


class BlockValues:
    """Scores texts by a block's (keys, counts) of words and (keys, values) of grams."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray], total: int, kinds: int, order: int = ORDER):
        self.order, (word, self.counts), (gram, self.values) = order, words, grams
        self.worth = np.log10((self.counts + 0.5) / (total + 0.5 * (kinds + 1)))
        self.of_word, self.of_gram = Finder(word), Finder(gram)

    def scores(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        for _, docs in parts_of(texts):
            keys, sizes = word_keys(docs)
            code, lengths = grams_of(docs, self.order)
            del docs
            at, place = self.of_word(keys), self.of_gram(code)
            if at.min() < 0 or place.min() < 0:
                raise ValueError("a word or gram of the block has no value")
            starts = np.cumsum(sizes) - sizes
            out[0].append(sizes)
            out[1].append(np.add.reduceat((self.counts[at] > 0).astype(np.int64), starts))
            out[2].append(np.add.reduceat(self.worth[at], starts))
            out[3].append(np.add.reduceat(self.values[place], np.cumsum(lengths) - lengths))
        return [np.concatenate(x) if x else np.zeros(0) for x in out]


def scored_groups(batches, low: dict[int, Contexts], order: int = ORDER, most: int = SLICE_GRAMS):
    """(keys, values) of grams that come sorted by their last ``BASE`` context bytes, (key, n) at a time; whole groups of them are scored together."""
    key, n, enough = np.zeros(0, np.int64), np.zeros(0, np.int64), most
    held: list[tuple] = []
    size = 0
    for b in batches:
        held.append((b.column("key").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)))
        size += b.num_rows
        if size < enough:
            continue
        key, n = (np.concatenate(x) for x in zip(*held))
        group = Contexts.masked(key.view(np.uint64), BASE) >> np.uint64(8)
        cut = int(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[-1])  # where the last group, maybe not whole yet, begins
        if cut:
            yield key[:cut], score_grams(key[:cut].view(np.uint64), n[:cut], low, order)
        held, size = [(key[cut:], n[cut:])], len(key) - cut
        enough = max(most, 2 * size)
    if size:
        key, n = (np.concatenate(x) for x in zip(*held))
        yield key, score_grams(key.view(np.uint64), n, low, order)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_remainder: int = 1, modulus: int = 5, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs, own = from_files(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "ppm-docs")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, parts = max(1, math.ceil(size / block_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = place_in_file(docs, lambda place: [F.pmod(F.xxhash64("doc_id", "text", place), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", (remainder("doc_id", modulus) == held_remainder).alias("held_out"), "text"])

    def dealt(rows: DataFrame) -> DataFrame:
        """Whole blocks in each partition, about as many in each."""
        return rows.repartitionById(parts, F.pmod("block", F.lit(parts)))

    def keys(batches):
        found, at, waiting = None, None, Buffer()

        def rows():
            if waiting.rows:
                found.add(*waiting.take())
            kind, key, n = found.rows()
            for a in range(0, len(kind), 200_000):
                z = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind[z]), at, np.int32)), pa.array(kind[z]), pa.array(key[z]), pa.array(n[z])], ["block", "kind", "key", "n"])
            give_back()

        for block, b in runs_of(batches, "block"):
            if block != at:
                if found:
                    yield from rows()
                found, at = BlockKeys(order), block
            if waiting.add(column_bytes(b.column("text")), [not h for h in b.column("held_out").to_pylist()]):
                found.add(*waiting.take())
        if found:
            yield from rows()

    gathered = dealt(blocks.select("block", "held_out", "text")).sortWithinPartitions("block").mapInArrow(keys, "block int, kind byte, key long, n long")
    rows = written(gathered, "ppm-keys", **SMALL_BATCHES)
    counts = written(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts", **SMALL_BATCHES)
    total, kinds = counts.where(f"kind = {WORD} and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counts.where(f"kind = {GRAM} and n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * BASE) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    low = spark.sparkContext.broadcast(orders_of(short.column("key").to_numpy().astype(np.uint64), short.column("n").to_numpy(), 0, BASE - 1))

    def scored(batches):
        for key, value in scored_groups(batches, low.value, order):
            for a in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(value[a : a + 100_000])], ["key", "value"])

    group = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * BASE) - 1)).alias("group")
    dealt_grams = counts.where(f"kind = {GRAM}").select("key", "n", group).repartition("group").sortWithinPartitions("group").select("key", "n")
    values = dealt_grams.mapInArrow(scored, "key long, value double").select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value")
    values = values.unionByName(counts.where(f"kind = {WORD}").select("kind", "key", F.col("n").cast("double").alias("value")))
    valued = written(values, "ppm-values", spark__sql__parquet__compression__codec="zstd")
    discard(counts)
    values = valued.select(F.col("kind").alias("k1"), F.col("key").alias("k2"), "value")
    wanted = rows.select("block", "kind", "key").join(values, (F.col("kind") == F.col("k1")) & (F.col("key") == F.col("k2"))).select("block", "kind", "key", "value")
    # one column to sort by: a block's words, its grams, its texts
    place = (F.col("block").cast("long") * 4 + F.col("kind")).alias("place")
    nothing = [F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text")]
    texts = blocks.withColumn("kind", F.lit(2)).select("block", place, F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "doc_id", "held_out", "text")
    both = dealt(wanted.select("block", place, "key", "value", *nothing).unionByName(texts)).drop("block").sortWithinPartitions("place")

    def judged(batches):
        held: list[list[tuple]] = [[], []]
        at, values, waiting = None, None, Buffer()

        def split(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            if not pairs:
                return np.zeros(0, np.uint64), np.zeros(0)
            key, value = (np.concatenate(x) for x in zip(*pairs))
            by_key = np.argsort(key.view(np.uint64))
            return key.view(np.uint64)[by_key], value[by_key]

        def rows():
            raw, ids, held_out = waiting.take()
            n_tokens, n_known, base, score = values.scores(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(held_out, pa.bool_()), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array([total] * len(score), pa.int64()), pa.array(base), pa.array(score)], names)

        names, id_arrow = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], None
        for k, b in runs_of(batches, "place"):
            block, kind = k >> 2, k & 3
            id_arrow = b.schema.field("doc_id").type
            if block != at:
                if waiting.rows:
                    yield from rows()
                held, at, values = [[], []], block, None
                give_back()
            if kind < 2:
                held[kind].append((b.column("key").to_numpy(zero_copy_only=False), b.column("value").to_numpy(zero_copy_only=False)))
                continue
            if values is None:
                values = BlockValues(split(held[WORD]), split(held[GRAM]), total, kinds, order)
                held = [[], []]
            if waiting.add(column_bytes(b.column("text")), b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()):
                yield from rows()
        if waiting.rows:
            yield from rows()

    fields = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = written(both.mapInArrow(judged, fields), "ppm-scores", **SMALL_BATCHES)
    discard(rows, valued, *own)
    return scores


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
