"""Toxicity: counterfactual penalty, edge rows, held-out accuracy."""
import zlib

import numpy as np

from riskweave.llm import toxicity
from riskweave.llm.queries import op1_toxicity


def biased_rows():
    """Toxic texts name one group more often, so a plain classifier learns the group."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        toxic = k % 2
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        filler = " ".join(f"w{rng.integers(30)}" for _ in range(8))
        insult = " vile" if toxic and rng.random() < 0.7 else ""
        rows.append((f"the {group} neighbour {filler}{insult}", toxic, 1.0))
    return rows


def test_counterfactual_term_removes_the_group_from_the_score():
    neutral = ["the muslim neighbour w1 w2", "the christian neighbour w1 w2"]
    plain = toxicity.fit_rows(biased_rows(), counterfactual=0.0)
    fair = toxicity.fit_rows(biased_rows(), counterfactual=20.0)
    gap = [abs(m.score(neutral[0]) - m.score(neutral[1])) for m in (plain, fair)]
    assert gap[0] > 0.3 and gap[1] < 0.2 * gap[0]
    assert fair.score("the muslim neighbour w1 vile") > fair.score("the muslim neighbour w1") + 0.1


def test_swap_stays_within_a_kind():
    terms = {w: line for line in toxicity.IDENTITY_TERMS for w in line}
    assert toxicity.swap("a woman and men".split(), terms, 0) == "a man and women".split()
    assert toxicity.swap("nothing here".split(), terms, 0) is None
    assert len({tuple(toxicity.swap(["sikh"], terms, s)) for s in range(3)}) == 3


def test_edges(spark, docs_schema):
    docs = spark.createDataFrame([(i, t, None, None, None, "e") for i, t in [(1, "bad bad"), (2, None), (3, ""), (1, "bad bad"), (None, "x"), (4, "ok " * 50_000)]], docs_schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == 6 and all(r.score < 1e-9 for r in rows)
    both = spark.createDataFrame([(1, 1), (1, None), (4, 0), (4, 0), (2, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, both, min_docs=1)).collect()}
    assert got[2] == got[3] and got[1] > got[4]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, both)).collect() == []


def test_query_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op1_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, y in held if y]) > 0.85 and np.mean([p for p, y in held if not y]) < 0.02


def test_the_sample_is_bounded_by_texts(spark, monkeypatch):
    """One labelled id holds most rows, one of its texts most of those: the driver gets each text once, and few of them."""
    docs = spark.range(20_000).selectExpr("CASE WHEN id < 18000 THEN 1 ELSE id END AS doc_id", "CASE WHEN id < 9000 THEN 'one text' ELSE concat('text ', id) END AS text")
    labels = spark.range(20_000).selectExpr("CASE WHEN id = 0 THEN 1 ELSE id END AS doc_id", "cast(id % 2 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, **_: seen.append(rows))
    toxicity.fit(docs, labels, per_class=50)
    rows = seen[0]
    assert 40 < len(rows) < 180 and len({t for t, _, _ in rows}) == len(rows)
    total = {y: sum(w for _, v, w in rows if v == y) for y in (0, 1)}
    assert abs(total[1] - (9001 + 1000)) < 1e-6 and abs(total[0] - 1000) < 1e-6
