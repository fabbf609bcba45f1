"""Quality classifier by co-training.

Two views of a document: its text content (hashed letter n-grams and shares of symbols, capitals, digits, repeated words and lines) and its metadata
(source, language and stated length). Each view has a logistic regression. Over ``ROUNDS`` rounds each goes through all unlabelled documents and labels the
``STEP`` of which it is most confident, in the labels' proportion, for the other. Both are then calibrated on a held-out fifth of the labelled documents and their
calibrated log odds are added, less the prior's.

Labelled documents are a sample of at most about ``SAMPLE`` labels, drawn by hash. The features of all unlabelled ones are written once; a round keeps
the best of each task, ranks those and fetches ``STEP`` for each view. Every document is scored and kept if its probability of quality is at least ``KEEP``.

Defined cases: a null text counts as empty and an empty text is rejected; null metadata are a value of their own; null labels aren't used;
rows and labels that repeat count once, and so do unlabelled copies; without labels of both kinds every document with a word is kept at 0.5. Repeated rows give repeated results. An empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, slices, table, written
from weftline.llm.linear import fit_logistic, gram_counts, margin, platt, sigmoid

GRAMS, SHARES, META = 256, 14, 128
SAMPLE, ROUNDS, STEP, KEEP, SEED = 4000, 4, 200, 0.5, 13
#: The margin from which a view counts as confident.
CONFIDENT = 1.0
CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"!", b"#*$%&|<>@^~_=+\\/{}[]`"), 1):
    CLASSES[list(_chars)] = _k
SQUEEZE = re.compile(rb"[0-9]+")


def text_view(text: bytes) -> np.ndarray:
    """GRAMS + SHARES numbers; linear in the text."""
    out = np.zeros(GRAMS + SHARES, np.float32)
    if not text.strip():
        return out
    counts = np.bincount(CLASSES, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8) / len(text)
    tokens = text.split()
    n = len(tokens)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    grams = np.sqrt(gram_counts(SQUEEZE.sub(b"0", text), GRAMS))
    norm = float(np.linalg.norm(grams))
    out[:GRAMS] = grams / norm if norm else grams
    out[GRAMS:] = [*(counts * 3), min(4.0, len(text) / n / 8), len(set(tokens)) / n, 3 * same / n, 1 - len(set(lines)) / len(lines), min(1.0, n / 50), np.log1p(n) / 12]
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed indicators of source, language and the logarithm of the stated length."""
    from xxhash import xxh32_intdigest

    out = np.zeros(META, np.float32)
    length = "null" if n_chars is None else str(max(0, int(n_chars)).bit_length())
    for field in (f"source={source}", f"lang={lang}", f"length={length}"):
        out[xxh32_intdigest(field, SEED) % META] += 1
    return out


class CoTrained:
    """The two views' models. draw(weights, (good, bad), known) gives for each view the (key, label, text row, metadata row) of the unlabelled documents of
    which it is most confident: so many good and bad ones, without the keys that it has labelled before."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, draw=None, rounds: int = ROUNDS, step: int = STEP):
        fold, views = np.arange(len(y)) % 5 == 0, (text, meta)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        train = ~fold if 0 < y[~fold].sum() < (~fold).sum() else np.ones(len(y), bool)
        extra: list[dict] = [{}, {}]  # by key, what the other view has labelled for this one

        def fit(v: int) -> np.ndarray:
            rows = [extra[v][k] for k in sorted(extra[v])]
            x = np.vstack([views[v][train], *[row[None] for _, row in rows]])
            t = np.concatenate([y[train], [label for label, _ in rows]]).astype(np.float32)
            weight = np.concatenate([np.ones(int(train.sum())), np.full(len(rows), 0.5)])
            weight = weight * np.where(t > 0, 0.5 / max(weight[t > 0].sum(), 1e-9), 0.5 / max(weight[t <= 0].sum(), 1e-9))
            return fit_logistic(x, t, weight)

        self.weights = [fit(0), fit(1)]
        good = int(round(step * float(y.mean())))
        for _ in range(rounds if draw else 0):
            for v, found in enumerate(draw(self.weights, (good, step - good), (set(extra[1]), set(extra[0])))):
                for key, label, *rows in found:
                    extra[1 - v][key] = label, rows[1 - v]
            self.weights = [fit(0), fit(1)]
        self.taught = extra
        held = fold if 0 < y[fold].sum() < fold.sum() else np.ones(len(y), bool)
        self.scales = [platt(margin(views[v][held], self.weights[v]), y[held]) for v in (0, 1)]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality: combined, by text, by metadata."""
        z = [self.scales[v][0] * margin(x, self.weights[v]) + self.scales[v][1] for v, x in ((0, text), (1, meta))]
        return sigmoid(z[0] + z[1] - self.prior), sigmoid(z[0]), sigmoid(z[1])


def _views(b):
    from weftline.llm.common import column_bytes

    text = np.stack([text_view(t or b"") for t in column_bytes(b.column("text"))])
    meta = np.stack([meta_view(*x) for x in zip(b.column("source").to_pylist(), b.column("lang").to_pylist(), b.column("n_chars").to_pylist())])
    return text, meta


def most_confident(key: np.ndarray, z: np.ndarray, wanted: tuple[int, int], known: set) -> tuple[list, list]:
    """(confidence, key) of the surest good and bad rows, each key once, best first."""
    out: tuple[list, list] = ([], [])
    for sign, n, found in ((1, wanted[0], out[0]), (-1, wanted[1], out[1])):
        sure = np.flatnonzero(sign * z > CONFIDENT)
        met = set()
        for k in sure[np.lexsort((key[sure], -sign * z[sure]))].tolist():
            if len(found) >= n:
                break
            if (h := int(key[k])) not in known and h not in met:
                met.add(h)
                found.append((float(sign * z[k]), h))
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, GRAMS + SHARES + META).astype(np.float32)


def drawn_from(features: DataFrame):
    """The ``draw`` of CoTrained over ``features(h, x)``: each task keeps its surest rows, and only the chosen ones' features reach the driver."""

    def draw(weights, wanted, known):
        def candidates(batches):
            import pyarrow as pa

            best: list[list] = [[], [], [], []]
            for b in batches:
                h, x = b.column("h").to_numpy(zero_copy_only=False), _matrix(b.column("x"))
                for v, part in ((0, x[:, : GRAMS + SHARES]), (1, x[:, GRAMS + SHARES :])):
                    for label, found in zip((1, 0), most_confident(h, margin(part, weights[v]), wanted, known[v])):
                        merged = {k: c for c, k in sorted(best[2 * v + label] + found)}
                        best[2 * v + label] = sorted(((c, k) for k, c in merged.items()), key=lambda r: (-r[0], r[1]))[: wanted[1 - label]]
            rows = [(k, c, h) for k, found in enumerate(best) for c, h in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.float64()), (2, pa.int64()))], ["list", "sure", "h"])

        once = features.mapInArrow(candidates, "list int, sure double, h long").groupBy("list", "h").agg(F.max("sure").alias("sure"))
        # the plain bound lets each partition keep its surest before they meet
        place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("sure"), "h"))
        chosen = once.withColumn("place", place).where(F.col("place") <= max(wanted)).where(F.col("place") <= F.when(F.col("list") % 2 == 1, wanted[0]).otherwise(wanted[1])).select("list", "h").collect()  # 2 x STEP rows at most
        keys = sorted({r["h"] for r in chosen})
        if not keys:
            return [], []
        got = features.where(F.col("h").isin(keys)).groupBy("h").agg(F.first("x").alias("x")).toArrow()
        rows = dict(zip(got.column("h").to_pylist(), _matrix(got.column("x"))))
        return tuple([(r["h"], r["list"] % 2, rows[r["h"]][: GRAMS + SHARES], rows[r["h"]][GRAMS + SHARES :]) for r in chosen if r["list"] // 2 == v] for v in (0, 1))

    return draw


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CoTrained | None:
    """``docs(doc_id, text, lang, source, n_chars)`` and ``labels(doc_id, quality)`` to the model, from a bounded sample of labels and all unlabelled documents."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("label_id"), (F.col("quality") > 0).cast("int").alias("y")).groupBy("label_id").agg(F.min("y").alias("y"))
    n_labels = labels.count()
    if not n_labels:
        return None
    share = F.lit(min(1 << 30, int((1 << 30) * sample / n_labels)))
    drawn = labels.where(F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(1 << 30)) < share)
    columns = ["text", "lang", "source", "n_chars", "h", "y"]
    keyed = docs.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED + 1)), F.lit(1 << 30)))
    known = keyed.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select(*columns)  # about SAMPLE rows at most
    once = known.groupBy("h").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")  # copies count once, so the sample stays bounded

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in slices(whole, 4 << 20):
                for c in range(0, part.num_rows, 4096):
                    b = part.slice(c, 4096)
                    rows = np.hstack(_views(b)).astype(np.float16)
                    rest = [n for n in b.schema.names if n in ("doc_id", "h", "y")]
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), *[b.column(n) for n in rest]], ["x", *rest])

    got = once.mapInArrow(run, "x binary, h long, y int").toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("x", "ascending")])
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = _matrix(got.column("x"))
    # h: what the features are made of, so that copies are one
    plain = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("text", "lang", "source", "n_chars").alias("h"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = plain.mapInArrow(run, f"x binary, doc_id {id_type}, h long")
    unlabelled = every.where("doc_id is not null").join(labels, F.col("doc_id") == F.col("label_id"), "left_anti").select("h", "x")
    features = written(unlabelled.unionByName(every.where("doc_id is null").select("h", "x")), "quality-features", spark__sql__parquet__compression__codec="zstd")
    model = CoTrained(x[:, : GRAMS + SHARES], x[:, GRAMS + SHARES :], y.astype(np.float32), drawn_from(features))
    discard(features)
    return model


def score_quality(docs: DataFrame, model: CoTrained | None, keep: float = KEEP) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in slices(whole, 4 << 20):
                for c in range(0, part.num_rows, 4096):
                    b = part.slice(c, 4096)
                    text, meta = _views(b)
                    some = text.any(1)
                    scores = shared.value.scores(text, meta) if shared.value else (np.full(len(text), 0.5),) * 3
                    both = np.where(some, scores[0], 0.0)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.asarray(s, np.float64)) for s in (both, *scores[1:])), pa.array((both >= keep) & some)], ["doc_id", "score", "text_score", "meta_score", "kept"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, text_score double, meta_score double, kept boolean")


def keep_quality(docs: DataFrame, model: CoTrained | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in slices(whole, 4 << 20):
                for c in range(0, part.num_rows, 4096):
                    b = part.slice(c, 4096)
                    text, meta = _views(b)
                    good = text.any(1)
                    if shared.value:
                        good &= shared.value.scores(text, meta)[0] >= keep
                    yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return score_quality(docs, fit_quality(docs, labels, **options))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
