import numpy as np
import pytest

from weftline.llm import pieces

ODD = ["", " ", "   ", " a", "a ", "a\tb", "\n", "x\n\n  y", "ﬁ①Ａ", "日本𝒳", "a▁b ▁ c", "<s>x</s>", "<0x0A>", "\x00a", "w" * 300, " " * 70 + "x" + " " * 33, "Hello  world\n x"]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def split(model, texts, *args):
    ids, n = model.encode([t if isinstance(t, bytes) else t.encode() for t in texts], *args)
    ends = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_without_dropout_like_the_library(model, texts):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=pieces.MODEL)
    given = [t for t in ODD if "▁" not in t] + list(texts.values())
    for t, got in zip(given, split(model, given, 0.0)):
        assert got == p.encode(t), t[:60]


def test_dropout_varies_and_loses_nothing(model, texts):
    given = ODD + list(texts.values())[:60] + [b"bad \xff\xfe bytes"]
    plain, one, again, other = (split(model, given, *x) for x in ((0.0,), (0.1, 1), (0.1, 1), (0.1, 2)))
    assert one == again and one != other and sum(map(len, one)) > sum(map(len, plain))
    for t, *found in zip(given, plain, one, other):
        assert all(model.decode(ids) == (t if isinstance(t, bytes) else t.encode()) for ids in found)


def test_total_dropout_gives_characters(model):
    assert split(model, ["abc"], 1.0) == [[model.id_of[c] for c in "▁abc"]]


def test_steps_and_heap_agree(model, texts):
    units = sorted({u for t in list(texts.values())[:20] for u in pieces.UNITS.findall("▁" + t.replace(" ", "▁")) if len(u) <= 24})
    keys = np.arange(len(units), dtype=np.uint64) * np.uint64(77)
    for rate in (0.0, 0.2, 0.7):
        flat, n = model.by_steps(units, keys, rate)
        ends = np.concatenate([[0], np.cumsum(n)])
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [model.by_heap(u, int(k), rate) for u, k in zip(units, keys)]


def test_round_trip_in_spark(make_docs):
    rows = [*enumerate(ODD), (90, None), (91, "long words " * 20_000), (91, "long words " * 20_000), (None, "x")]
    docs = make_docs(rows)
    encoded = pieces.encode_documents(docs)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all((r.n_ids is None) == (dict(rows)[r.doc_id] is None) and (r.ids is None or len(r.ids) == r.n_ids) for r in got)
    back = sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in pieces.decode_documents(encoded).collect())
    assert back == sorted((i is None, i, t is None, t) for i, t in rows)
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_each_occurrence_has_draws_of_its_own(make_docs):
    def ways(rows):
        from collections import defaultdict

        got, pieces_of = defaultdict(set), pieces._pieces(pieces._model(pieces.MODEL)).bytes_of
        for r in pieces.encode_documents(make_docs(rows)).collect():
            assert r.lossless
            cuts = "|".join(pieces_of[i].decode() for i in r.ids).replace("| ", "\n ").split("\n")
            got[r.doc_id] |= set(cuts[1:])
        return got

    in_one = ways([(1, " ".join(["international"] * 500))])
    assert len(in_one[1]) > 4
    over_all = ways([(k, f"{k} international") for k in range(200)])
    assert len({v for own in over_all.values() for v in own if v.replace("|", "") == " international"}) > 4
    assert ways([(2, "international words " * 40)])[2] == ways([(2, "international words " * 40)])[2]
