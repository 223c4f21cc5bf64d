"""Fit samples stay at their documented size when ids are null or repeated, texts equal or not."""
import pytest

from riskweave.llm import langid, licences


@pytest.mark.parametrize("ids", ["if(id % 3 > 0, id, null)", "7", "null"])
@pytest.mark.parametrize("text", ["concat('some words ', id)", "'some words'"])
def test_sample_sizes(spark, monkeypatch, ids, text):
    docs = spark.range(12_000).selectExpr(f"cast({ids} as long) as doc_id", f"{text} as text", "if(id % 2 = 0, 'aa', 'bb') as lang")
    taken = []
    monkeypatch.setattr(langid, "fit_rows", lambda texts: taken.append([x for _, x in texts]))
    monkeypatch.setattr(licences, "fit_rows", lambda texts: taken.append(texts))
    langid.fit(docs, per_lang=300)
    licences.fit(docs, sample_docs=300)
    assert all(200 < n < 400 for n in (taken[0].count("aa"), taken[0].count("bb"), len(taken[1])))
