"""Chosen-path join against all pairs: links counted exactly, components equal, classes of copies, edge rows."""
import random
import re

import pyarrow as pa
import pytest

from riskweave.llm import jaccardjoin


def grams(text, w=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[k:k + w]) for k in range(len(words) - w + 1)} or ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(500)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 30, 120, 400]))]
        if k % 3 == 0:
            words = passage.split() + words  # shared by many that are not alike
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            w = words[:]
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            out.append(" ".join(w))
    hot = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):
        w = hot[:]
        w[rng.randrange(150)] = "hot" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("small", "chunk", "mass", "levels"), [(64, 2048, 10**7, 4), (4, 2048, 10**7, 3), (64, 16, 10**7, 2), (64, 2048, 900, 2)])
def test_equals_all_pairs(spark, texts, small, chunk, mass, levels):
    n = len(texts)
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccardjoin.join(df, recall=0.999999, levels=levels, small=small, chunk=chunk, chunk_shingles=mass).collect()}
    assert [got[i].n_links for i in range(n)] == links
    assert [got[i].class_id for i in range(n)] == [find(i) for i in range(n)]


def test_edges_and_columns(spark, docs_schema):
    rows = [(1, "one two"), (1, "one two"), (2, "One, two!"), (3, None), (4, ""), (5, "?!"), (None, "a b c d e f g"), (6, "a b c d e f g"), (7, "w " * 60_000), (7, "other words here"),
            (8, "w " * 60_000 + "end")]
    df = spark.createDataFrame([(i, t, "x", "s", None, "e") for i, t in rows], docs_schema)
    got = jaccardjoin.join(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_links for r in by[1]] == [2, 2] and by[2][0].class_id == 1 and by[2][0].equal_docs == 3
    assert [by[k][0].n_links for k in (3, 4, 5)] == [0, 0, 0] and by[3][0].class_id == 3
    assert by[None][0].n_links == 1 and by[6][0].class_id is None
    out = jaccardjoin.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in out.collect()), key=repr) == sorted(
        [(1, "one two"), (3, ""), (4, ""), (5, "?!"), (None, "a b c d e"), (7, "other wor"), (7, "w w w w w"), (8, "w w w w w")], key=repr)
    assert jaccardjoin.join(df.limit(0)).collect() == [] and jaccardjoin.keep_one_of_each(df.limit(0)).collect() == []


def test_runs_follow_from_recall():
    assert jaccardjoin.runs_needed(0.999, 3.0, 4) == 5 and jaccardjoin.runs_needed(0.5, 3.0, 1) == 1


def test_repeated_rows_bring_one_text(spark, monkeypatch):
    """Each row that reaches the comparison counts as a link here: a class's text is in a part once."""
    def rows_as_links(width, threshold):
        def run(batches):
            for b in batches:
                cls = b.column(b.schema.get_field_index("cls"))
                yield pa.RecordBatch.from_arrays([cls, pa.array([1] * len(cls), pa.int64()), cls], names=["cls", "links", "root"])
        return run

    monkeypatch.setattr(jaccardjoin, "compare", rows_as_links)
    text = " ".join(f"w{k}" for k in range(200))
    for did in (1, None):
        df = spark.createDataFrame([(did, text)] * 30 + [(2, text + " end")], "doc_id long, text string")
        got = {r.doc_id: r.n_links for r in jaccardjoin.join(df).collect()}
        assert got == {did: 1 + 29, 2: 1}
