"""Language identification by hierarchical discrimination.

Features are hashed byte bigrams and trigrams of the lower-cased letters of the whole text. One-versus-rest linear support vector machines choose the
language family; within it one-versus-one machines for each pair of its languages vote, ties going to the larger sum of margins. The score is the product
of the calibrated probabilities of the family and of the language against its strongest rival.

The fit uses ``SAMPLE`` distinct texts of each language, or as many as share ``MOST`` among all, but ``LEAST`` at least, or all that a language has. They
are drawn by a hash of the text from those with a language; every language is learned, and copies count once. Only text and language are used. Every
document is scored.

Defined cases: a null text or one without a letter is "und" with score 0; languages that FAMILIES doesn't list are a family each; with one learned
language each text with a letter is that; without labelled documents every text is "und". Null ids are held in. Repeated rows give repeated results. An
empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import drawn_by_hash, remainder, slices, table
from weftline.llm.linear import fit_svm, letter_grams, margin, platt, sigmoid

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "baltic": "lt lv",
    "indic": "hi bn ur mr gu pa ne",
}
SIZE, SAMPLE, MOST, LEAST, UNKNOWN, SEED = 4096, 800, 4000, 20, "und", 11
LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs.split()), f"only {lang}")


class Hierarchy:
    """The fitted machines. Their size depends on the number of languages only."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array([family_of(v) for v in langs])
        lang = np.array(langs)
        self.families = sorted(set(own.tolist()))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        fold = np.arange(len(langs)) % 5 == 0

        def machine(use: np.ndarray, yes: np.ndarray):
            y = np.where(yes, 1.0, -1.0).astype(np.float32)
            held = use & fold
            first = fit_svm(x[use & ~fold], y[use & ~fold]) if (use & ~fold).any() else fit_svm(x[use], y[use])
            slope, shift = platt(margin(x[held], first), y[held]) if held.any() else (1.0, 0.0)
            return fit_svm(x[use], y[use]), slope, shift

        everything = np.ones(len(langs), bool)
        self.rest = {f: machine(everything, own == f) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {(a, b): machine((lang == a) | (lang == b), lang == a) for f in self.families for a, b in combinations(self.members[f], 2)}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if self.rest:
            z = np.stack([s * margin(x, w) + t for w, s, t in (self.rest[f] for f in self.families)], 1)
            top = z.argmax(1)
            p = sigmoid(z)
            share = p[np.arange(n), top] / np.maximum(p.sum(1), 1e-9)
        else:
            top, share = np.zeros(n, int), np.ones(n)
        out, score = [""] * n, np.zeros(n)
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(top == k), self.members[f]
            if not len(rows):
                continue
            votes, sums, least = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                w, slope, shift = self.pairs[a, b]
                z = slope * margin(x[rows], w) + shift
                votes[:, i] += z >= 0
                votes[:, j] += z < 0
                sums[:, i] += z
                sums[:, j] -= z
                least[:, i] = np.minimum(least[:, i], sigmoid(z))
                least[:, j] = np.minimum(least[:, j], sigmoid(-z))
            best = (votes + 1e-3 * np.tanh(sums)).argmax(1)
            for r, b in zip(rows.tolist(), best.tolist()):
                out[r] = langs[b]
            score[rows] = share[rows] * least[np.arange(len(rows)), best]
        return out, np.clip(score, 0.0, 1.0)


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def fit_languages(labelled: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> Hierarchy | None:
    """``labelled(text, lang)`` to the machines, from ``sample`` distinct texts of each language at most."""
    labelled = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    once = drawn_by_hash(labelled, "lang", "text", lambda n: min(sample, MOST / n), LEAST, seed=SEED)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 16 << 20):
                rows = [(letter_grams(t, size).astype(np.float16).tobytes(), lang, h) for t, lang, h in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("h").to_pylist()) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["x", "lang", "h"])

    drawn = once.select("text", "lang", "h").mapInArrow(run, "x binary, lang string, h long").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    if not drawn.num_rows:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in drawn.column("x").to_pylist()]).astype(np.float32)
    return Hierarchy(x, drawn.column("lang").to_pylist())


def identify(docs: DataFrame, model: Hierarchy | None, text: str = "text", size: int = SIZE) -> DataFrame:
    """Adds lang_pred and score to the other columns of ``docs``, which lose ``text``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(*rest, F.col(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 4 << 20):
                for c in range(0, b.num_rows, 2048):
                    part = b.slice(c, 2048)
                    langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                    texts = part.column("text").to_pylist()
                    at = [k for k, t in enumerate(texts) if has_letter(t)] if shared.value else []
                    if at:
                        x = np.stack([letter_grams(texts[k], size) for k in at])
                        found, score = shared.value.predict(x)
                        for k, v, s in zip(at, found, score):
                            langs[k], scores[k] = v, s
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], pa.array(langs, pa.string()), pa.array(scores)], [*rest, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Hierarchy | None, least: float = 0.25, wanted: tuple | None = None) -> DataFrame:
    """The rows of ``docs`` with a language of ``wanted`` (None: any learned one) at a score of ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 4 << 20):
                for c in range(0, b.num_rows, 2048):
                    part = b.slice(c, 2048)
                    texts, good = part.column("text").to_pylist(), np.zeros(part.num_rows, bool)
                    at = [k for k, t in enumerate(texts) if has_letter(t)] if shared.value else []
                    if at:
                        langs, scores = shared.value.predict(np.stack([letter_grams(texts[k], SIZE) for k in at]))
                        good[at] = [s >= least and (wanted is None or v in wanted) for v, s in zip(langs, scores)]
                    yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_remainder: int = 2, modulus: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``; learned from those not held out."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), (remainder(doc_id, modulus) == held_remainder).alias("held_out"))
    model = fit_languages(docs.where("not held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
