import zlib

import numpy as np

from weftline.llm import language


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = language.op10_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_prediction_doesnt_read_labels(spark, make_docs):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * (1 + k % 5), "a", "en" if k % 2 else "de") for k in range(60)]
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(make_docs(rows)).collect()}
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    other = [(k, t, "zz", None if k in held else v) for k, t, _, v in rows]
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(make_docs(other)).collect()}
    assert {v for v, _ in one.values()} == {"en", "de"}


def test_edges(make_docs):
    rows = [(k, f"words number {k} in english", "a", "en") for k in range(20)] + [(100, None), (101, ""), (102, "123 !?"), (103, "x " * 50_000), (103, "x " * 50_000), (None, "words")]
    got = language.language_id(make_docs(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (100, 101, 102)) and by[103].lang_pred == "en" and by[None].held_out is False
    assert {r.lang_pred for r in language.language_id(make_docs([(1, "text", "a", None)])).collect()} == {"und"}
    assert language.language_id(make_docs(rows).limit(0)).count() == 0


def test_families():
    assert language.family_of("fr") == language.family_of("es-MX") == "romance" and language.family_of("qq") == "only qq"
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (3, 16))
    langs = [("fr", "es", "de")[k % 3] for k in range(240)]
    x = np.array([centres[k % 3] + rng.normal(0, 0.3, 16) for k in range(240)], np.float32)
    model = language.Hierarchy(x, langs)
    assert set(model.rest) == {"romance", "germanic"} and set(model.pairs) == {("es", "fr")}
    assert np.mean([a == b for a, b in zip(model.predict(x)[0], langs)]) > 0.95


def test_copies_dont_starve_a_language(make_docs):
    few = [(f"der hund und die katze gehen heute nach hause nummer {chr(97 + k)}", "de") for k in range(5)]
    many = [(f"the cat and the dog go home {chr(97 + k % 26)}{chr(97 + k // 26)}", "en") for k in range(60)]
    docs = make_docs([(k, t, "a", v) for k, (t, v) in enumerate(few * 4000 + many)]).select("text", "lang")
    model = language.fit_languages(docs, sample=10)
    assert model.langs == ["de", "en"]
    text_of_each = language.drawn_by_hash(docs, "lang", "text", lambda n: 10).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in text_of_each} == {"de": 5, "en": 10}


def test_every_language_is_learned(make_docs):
    rows = [(k, f"{chr(97 + k // 20 % 26)}{chr(97 + k // 520)} word {'abc'[k % 3]}", "a", f"q{k // 2}") for k in range(520)]
    assert len(language.fit_languages(make_docs(rows).select("text", "lang"), size=256).langs) == 260
