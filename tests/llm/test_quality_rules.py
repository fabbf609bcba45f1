import re
from collections import Counter

from weftline.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_base_counts_like_brute_force(spark, sf_dir, texts):
    for r in quality_rules.op2_quality_rules(spark, sf_dir).collect():
        n = plain(texts[r.doc_id])
        assert base(r) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)


def test_edges(make_docs):
    cases = [None, "", " \n ", "é" * 3, "a b c a b c", "x\nx\n\nx ", "a b c d", "#*$%&|<>", "w " * 5000, "a\x0bb\x0cc\rd"]
    got = {r.doc_id: r for r in quality_rules.quality_rules(make_docs(list(enumerate(cases)))).collect()}
    assert {k: base(r) for k, r in got.items()} == {k: plain(c) for k, c in enumerate(cases)}
    assert quality_rules.quality_rules(make_docs([]).limit(0)).count() == 0


def test_frequent_lines_deplete(make_docs):
    own = [" ".join(f"u{k}x{j}" for j in range(60)) for k in range(40)]
    shared = "Read our terms  of use"
    rows = [(k, f"{own[k]}\n{shared.upper() if k % 2 else shared}", "h") for k in range(30)]
    rows += [(100, "\n".join([shared] * 30), "h"), (101, "\n".join([shared] * 30), "other"), (102, own[35], None), (102, own[35], None)]
    got = {}
    for r in quality_rules.quality_rules(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[k][0].kept and got[k][0].n_removed_words == 5 for k in range(30))
    assert got[100][0].n_removed_words == 150 and not got[100][0].kept
    assert got[101][0].n_removed_words == 0
    assert len(got[102]) == 2 and all(r.kept for r in got[102])


def test_repeated_rows_are_removed_once_each(make_docs):
    rows = [(1, "shared line of words\n" + " ".join(f"v{j}" for j in range(60)), "h")] * 30
    got = quality_rules.quality_rules(make_docs(rows)).collect()
    assert len(got) == 30 and {r.n_removed_words for r in got} == {64}


def test_a_hot_host_has_the_limit_of_any_large_one(make_docs):
    filler = [" ".join(f"f{k}x{j}" for j in range(60)) for k in range(60)]
    rows = [(k, filler[k % 60] + f" {k}", "hot") for k in range(400)] + [(1000 + k, "the licence line", "hot") for k in range(12)]
    docs = make_docs(rows)
    assert quality_rules.quality_rules(docs, most_docs=10).where("n_removed_words > 0").count() == 12
    assert quality_rules.quality_rules(docs, max_share=0.2).where("n_removed_words > 0").count() == 0


def test_cleaned_texts(spark, make_docs):
    own = [" ".join(f"u{k}x{j}" for j in range(60)) for k in range(40)]
    rows = [(k, f"{own[k]}\n\n Read our\tTERMS \nmore{k} words again", "h") for k in range(30)] + [(50, "read our terms\n" * 40, "h"), (51, own[35], None), (51, own[35], None), (None, None, "h")]
    got = quality_rules.clean_documents(make_docs(rows))
    assert got.columns == make_docs(rows).columns
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert texts == sorted([(k, f"{own[k]}\n\nmore{k} words again") for k in range(30)] + [(51, own[35])] * 2, key=str)
    clash = make_docs(rows).selectExpr("*", "1 as _w", "2 as _l", "3 as n_words", "4 as row", "5 as gone")
    assert quality_rules.clean_documents(clash).count() == 32 and quality_rules.clean_documents(clash.limit(0)).count() == 0
