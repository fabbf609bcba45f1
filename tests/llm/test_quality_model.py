import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality_model


def test_accuracy_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    got = quality_model.classify_quality(docs, even).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.9
    good = [r.kept for r in got if r.quality == 1]
    assert np.mean(good) > 0.95


def test_each_document_is_scored(spark, sf_dir, texts):
    rows = quality_model.op7_quality_classifier(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(0 <= x <= 1 for r in rows for x in (r.score, r.text_score, r.meta_score))


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    signal = (2 * y - 1)[:, None] * np.ones((1, 4)) + rng.normal(0, 1.0, (600, 4))
    text, meta = signal.astype(np.float32), (signal[:, ::-1] + rng.normal(0, 1.0, (600, 4))).astype(np.float32)
    few = np.arange(24)

    def draw(weights, wanted, known):
        keys, found = np.arange(24, 424), []
        for v, view in enumerate((text, meta)):
            lists = quality_model.most_confident(keys, quality_model.margin(view[24:424], weights[v]), wanted, known[v])
            assert not known[v] & {h for rows in lists for _, h in rows}
            found.append([(h, label, text[h], meta[h]) for label, rows in zip((1, 0), lists) for _, h in rows])
        return found

    alone = quality_model.CoTrained(text[few], meta[few], y[few].astype(np.float32))
    taught = quality_model.CoTrained(text[few], meta[few], y[few].astype(np.float32), draw)
    assert taught.taught[0] and taught.taught[1]
    right = [np.mean((m.scores(text[424:], meta[424:])[0] >= 0.5) == y[424:]) for m in (alone, taught)]
    assert right[1] >= right[0] - 0.02 and right[1] > 0.85


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "Some words."), (3, "Some words."), (None, "More words."), (4, "long text " * 30_000)]
    docs = make_docs(rows).withColumn("source", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.classify_quality(docs, none).collect()
    assert len(got) == 6 and {r.doc_id: r.kept for r in got} == {1: False, 2: False, 3: True, None: True, 4: True}
    one_kind = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert quality_model.classify_quality(docs, one_kind).where("kept").count() == 4
    some = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    assert quality_model.classify_quality(docs, some).count() == 6
    assert quality_model.classify_quality(docs.limit(0), some).count() == 0
    assert quality_model.keep_quality(docs, None).columns == docs.columns


def test_the_surest_of_all_are_drawn_once_each(spark):
    rng = np.random.default_rng(1)
    width = quality_model.GRAMS + quality_model.SHARES + quality_model.META
    x = rng.normal(0, 1, (500, width)).astype(np.float16)
    weights = [rng.normal(0, 0.2, quality_model.GRAMS + quality_model.SHARES + 1), rng.normal(0, 0.2, quality_model.META + 1)]
    rows = [(k, x[k].tobytes()) for k in range(500)] + [(k, x[k].tobytes()) for k in range(100)] * 3
    known = ({1, 2, 3}, set(range(0, 500, 2)))
    got = quality_model.drawn_from(spark.createDataFrame(rows, "h long, x binary").repartition(7))(weights, (20, 30), known)
    for v, part in ((0, x[:, : quality_model.GRAMS + quality_model.SHARES]), (1, x[:, quality_model.GRAMS + quality_model.SHARES :])):
        z = quality_model.margin(part.astype(np.float32), weights[v])
        free = [k for k in range(500) if k not in known[v]]
        good = sorted((k for k in free if z[k] > 1), key=lambda k: -z[k])[:20]
        bad = sorted((k for k in free if z[k] < -1), key=lambda k: z[k])[:30]
        assert sorted((k, label) for k, label, *_ in got[v]) == sorted([(k, 1) for k in good] + [(k, 0) for k in bad])
        assert all((text == x[k][: quality_model.GRAMS + quality_model.SHARES]).all() for k, _, text, _ in got[v])


def test_labelled_documents_teach_nothing_else(spark, make_docs, monkeypatch):
    rows = [(k, f"word{k} and so on, with some more words here. " * 3) for k in range(60)] + [(None, "without an id, these words. " * 4)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = {}

    def spy(features):
        seen["n"] = features.count()
        return lambda *_: ([], [])

    monkeypatch.setattr(quality_model, "drawn_from", spy)
    assert quality_model.fit_quality(make_docs(rows), labels) is not None and seen["n"] == 21
