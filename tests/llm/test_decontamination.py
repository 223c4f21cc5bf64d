"""Containment search against brute force: planted whole and damaged items, short items, edge rows, several item blocks."""
import re

import numpy as np
import pytest

from riskweave.llm import decontamination

WORDS = [f"w{k}" for k in range(4000)]


def shingle_set(text, w):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[k:k + w]) for k in range(len(words) - w + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    sets = {w: [(d, shingle_set(t, w)) for d, t in docs] for w in range(1, 6)}
    for i, q in items:
        w = min(5, len(re.findall(r"\w+", (q or "").lower())))
        own = shingle_set(q, w) if w else set()
        out |= {(d, i) for d, s in sets.get(w, []) if own and len(own & s) >= threshold * len(own) - 1e-9}
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 120)))) for i in range(120)]
    docs = []
    for d in range(300):
        words = list(rng.choice(WORDS, rng.integers(0, 3000)))
        if d % 2:
            q = items[rng.integers(120)][1].split()
            for _ in range(rng.integers(0, 3)):
                if d % 3 == 0:
                    q[rng.integers(len(q))] = "changed"
            at = rng.integers(0, len(words) + 1)
            words[at:at] = [q[0].upper(), *q[1:]]
        docs.append((d, " ".join(words) + "."))
    return docs, items


@pytest.mark.parametrize("block_words", [4_000_000, 2000])
def test_equals_brute_force(spark, planted, block_words):
    docs, items = planted
    got = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))
    assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in got)


def test_edges(spark, docs_schema):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "x a b c d e f y"), (4, "q " * 100_000 + "a b c d e f"), (5, "Hello, world!")]
    docs = spark.createDataFrame([(i, t, None, None, None, "e") for i, t in rows], docs_schema)
    items = spark.createDataFrame([(7, "A b c d e f"), (7, "a b c d e f"), (8, None), (9, "!?"), (10, "hello world"), (None, "d e")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.search(docs, items).collect()), key=repr)
    want = [(d, 7) for d in (1, 1, 4, None)] * 2 + [(d, None) for d in (1, 1, 4, None)] + [(5, 10)]
    assert got == sorted(want, key=repr)
    assert decontamination.search(docs.limit(0), items).collect() == []
    assert decontamination.search(docs, items.limit(0)).collect() == []
