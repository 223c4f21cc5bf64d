"""Language ID: forward-backward against enumeration, held-out accuracy, code-switched text, edge rows."""
import itertools
import zlib

import numpy as np
import pytest

from riskweave.llm import langid
from riskweave.llm.queries import op3_language_id

WORDS = {"aa": "the thing which there with those them".split(), "bb": "der schnee schule straße und nicht wurde".split()}


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return langid.fit_rows([(" ".join(rng.choice(WORDS[x], 60)), x) for x in WORDS for _ in range(40)], steps=20)


def brute(e, a):
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = np.log(np.exp(a)[:, path[0]].sum()) + e[0, path[0]]
        s += sum(a[path[t - 1], path[t]] + e[t, path[t]] for t in range(1, n))
        for t in range(n):
            out[t, path[t]] += np.exp(s)
    return out / out.sum(1, keepdims=True)


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 3)
    rng = np.random.default_rng(0)
    sizes = [1, 8, 3, 0, 7, 4]
    e, a = rng.normal(size=(sum(sizes), 2)), rng.normal(size=(2, 2))
    got = langid.marginals(e, np.repeat(np.arange(len(sizes)), sizes), len(sizes), a)
    at = 0
    for n in sizes:
        if n:
            assert np.allclose(got[at:at + n], brute(e[at:at + n], a))
        at += n


def test_code_switched_runs_and_edges(spark, model, docs_schema):
    text = " ".join(WORDS["aa"] * 2 + WORDS["bb"] * 2)
    rows = [(1, text), (2, None), (3, ""), (4, "12 34 !?"), (5, "the " * 30_000), (5, "the"), (None, "schnee"), (6, "q" * 50_000), (7, "½ Ⅷ ²")]
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema)
    got = langid.label(df, model, spans=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert [x.lang for x in by[1].runs] == ["aa", "bb"] and by[1].switches == 1
    assert text[by[1].runs[1].start:by[1].runs[1].end] == " ".join(WORDS["bb"] * 2)
    assert [by[k].lang_pred for k in (2, 3, 4, 7)] == ["und"] * 4 and by[2].score == 0
    assert by[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)
    assert langid.label(spark.createDataFrame([], docs_schema), model).collect() == []


def test_nothing_labelled(spark, docs_schema):
    df = spark.createDataFrame([(1, "some text", None, None, None, "e")], docs_schema)
    assert langid.label(df, langid.fit(df)).collect()[0].lang_pred == "und"


def test_query_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op3_language_id(spark, d).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_every_letter_of_a_long_run_counts():
    """A run of 48 letters whose middle alone tells the language."""
    edge = "x" * 16
    texts = [(edge + mid * 2 + edge, lang) for lang, mid in (("aa", "abcdabcd"), ("bb", "efghefgh")) for _ in range(60)]
    assert all(len(langid.words_of(t)) == 2 and "".join(langid.words_of(t)) == t for t, _ in texts)
    m = langid.fit_rows([(" ".join([t] * 6), lang) for t, lang in texts], steps=20)
    assert langid.label_texts([edge + "abcd" * 4 + edge, edge + "efgh" * 4 + edge], m).pred == ["aa", "bb"]


def test_sequences_follow_the_languages():
    texts = [(" ".join(f"w{chr(97 + k % 26)}{lang}" for k in range(4000)), lang) for lang in ("aa", "bb", "cc")]
    for per_lang in (5, 1500):
        seqs, _ = langid.training_sequences(texts, ["aa", "bb", "cc"], 48, 1, per_lang)
        assert len(seqs) == min(3 * per_lang, 12_000 // 48 + 1)


def test_languages_beyond_the_bound_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"wort{'abcdefghij'[i % 5]} " * 20, f"l{i % 5}") for i in range(100)] + [(900, "selten " * 20, "rare")], "doc_id long, text string, lang string")
    assert langid.fit(docs, max_langs=5, steps=2).langs == [f"l{k}" for k in range(5)]
    assert "rare" in langid.fit(docs, steps=2).langs
