"""Fuzzy lines against all pairs: every similar pair well above the threshold is linked, and nothing that is not."""
import random

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import linededup
from riskweave.llm.shingles import char_shingles


def jaccard(a, b, w=8):
    x, y = ({t[k:k + w] for k in range(len(t) - w + 1)} or {t} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("xyzq")
    return "".join(out)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([3, 8, 14, 30, 90]))) for _ in range(60)]
    out = []
    for x in base:
        out += [x] * rng.randint(1, 3) + [edited(rng, x, rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]
    hot = " ".join("hot" + str(k) for k in range(60))
    out += [edited(rng, hot, 1) for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [4096, 16])
def test_equals_all_pairs(spark, lines, chunk):
    docs = [(d, "\n".join([*lines[d * 5:d * 5 + 5], " ", ""])) for d in range(-(-len(lines) // 5))]
    got = linededup.classes(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk).collect()
    at = {(r.doc_id, r.line_no): r for r in got}
    where = [(k // 5, k % 5) for k in range(len(lines))]
    assert set(at) == set(where)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sure = []
    for i in range(len(lines)):
        for j in range(i):
            s = jaccard(lines[i], lines[j])
            if s >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
            if s >= 0.9:
                sure.append((i, j))
    cls = [(at[w].class_doc_id, at[w].class_line_no) for w in where]
    assert all(cls[i] == cls[j] for i, j in sure)
    assert all(find(i) == find(j) for i in range(len(lines)) for j in range(i) if cls[i] == cls[j])
    assert len(set(cls)) <= 1.02 * len({find(i) for i in range(len(lines))})
    for w, c in zip(where, cls, strict=True):
        assert c <= w and at[w].kept == (c == w)


def test_edges_and_columns(spark, docs_schema):
    rows = [(1, "same line here\nown line of one"), (1, "same line here\nown line of one"), (2, "same line here"), (3, None), (4, ""), (5, " \n\t"),
            (None, "first of all\nq"), (6, "q\n\n" + "very long " * 20_000), (7, "tail"), (7, "other tail")]
    df = spark.createDataFrame([(i, t, "x", "s", None, "e") for i, t in rows], docs_schema)
    got = linededup.classes(df).collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 7
    out = linededup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(1, rows[0][1]), (3, None), (4, ""), (5, " \n\t"), (None, "first of all\nq"), (6, "\n" + "very long " * 20_000), (7, "tail"), (7, "other tail")], key=repr)
    assert linededup.classes(df.limit(0)).collect() == [] and linededup.drop_repeated_lines(df.limit(0)).collect() == []


def test_line_id_is_sparks_hash(spark):
    lines = ["", "a", "é日本", "x" * 100]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").selectExpr("xxhash64(t)").collect()] == [linededup.line_id(x) for x in lines]


def test_signatures_estimate_similarity():
    rng = random.Random(0)
    b = linededup.Banding(8, 50, 1)
    for size in (30, 90, 400):
        line = "".join(rng.choice("abcdefghijklm ") for _ in range(size))
        other = edited(rng, line, max(1, size // 90))
        h, n = b([line, other])
        k = min(n)
        shared = np.mean([np.mean(h[:n[0]][i * 50:i * 50 + 50] == h[n[0]:][i * 50:i * 50 + 50]) for i in range(k // 50)])
        assert abs(shared - jaccard(line, other)) < 0.25


def test_shingles_of_many_texts_are_those_of_each():
    texts = ["abcdefghijk", "abc", "日本語のテキストです。", "a" * 50]
    h, n = char_shingles(texts, 8)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert (char_shingles([t], 8)[0] == h[at[k]:at[k + 1]]).all()


@pytest.mark.parametrize(("chunk", "chunk_chars"), [(64, 10**6), (10**6, 64_000)])
def test_large_bands_are_dealt_out(spark, chunk, chunk_chars):
    """1,000 lines of 1,000 characters and 5 others: every pair of a band meets, in no group much over two chunks."""
    bands = {k: [1, 2] if k < 1000 else [3] if k < 1003 else [4, k] for k in range(1005)}
    rows = [(k, 1000, b) for k, b in bands.items()] + [(5, 1000, [1, 2])] * 20
    df = spark.createDataFrame(rows, "lid long, chars int, bands array<long>")
    groups = {}
    for r in linededup.met_lines(df, 10, chunk, chunk_chars).collect():
        groups.setdefault(r.group, []).append(r.lid)
    assert all(len(g) == len(set(g)) < 64 * 4 for g in groups.values())
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert met == {(a, b) for a in bands for b in bands if a < b and set(bands[a]) & set(bands[b])}
    assert len(groups) < 16 * 17 // 2 + 5  # the two bands of the same lines were taken once


def test_shingles_of_some_groups_at_a_time(monkeypatch):
    """Groups of long lines that come in one batch: their shingles are not all held at once."""
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefgh", k=40_000)) for _ in range(150)]
    held, whole = [], linededup.shingle_sets
    monkeypatch.setattr(linededup, "shingle_sets", lambda some, width: held.append(sum(map(len, some))) or whole(some, width))
    batch = pa.RecordBatch.from_arrays([pa.array([k // 2 for k in range(300)]), pa.array(range(300)), pa.array([x for x in lines for _ in range(2)])], names=["group", "lid", "line"])
    edges = {(a, b) for got in linededup.link(8, 0.8)([batch]) for a, b in zip(*(c.to_pylist() for c in got.columns), strict=True)}
    assert edges == {(2 * k, 2 * k + 1) for k in range(150)}
    assert sum(held) == 300 * 40_000 and max(held) <= 4_100_000


def test_repeated_rows_bring_one_line(spark, monkeypatch):
    def rows_as_edges(width, threshold):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("lid", "group")], names=["a", "b"])
        return run

    edges = []
    monkeypatch.setattr(linededup, "link", rows_as_edges)
    monkeypatch.setattr(linededup, "components", lambda e: edges.extend(tuple(r) for r in e.collect()) or spark.createDataFrame([], "node long, root long"))
    line = "a line of some words that many rows have"
    linededup.classes(spark.createDataFrame([(1, line)] * 30 + [(None, line + "!")] * 30, "doc_id long, text string"))
    assert {a for a, _ in edges} == {linededup.line_id(line), linededup.line_id(line + "!")}
    assert len(edges) == len(set(edges))
