"""Spelling variants against a plain reading of the contract: every pair of words compared."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import spelling


def close(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, mod=97, least=5, often=3):
    c = Counter()
    for i, t in rows:
        runs = Counter("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r) for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
        for r, n in runs.items():
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % mod == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            c[r] += n
    n = {w: k for w, k in c.items() if k >= often and len(w) >= least}
    others = {w: [v for v in n if close(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        top = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(others[w]), n.get(form[w])) for w in n) if n else []


def corpus(seed, letters, docs, low=4, high=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(60)]
    out = []
    for d in range(docs):
        words = []
        for _ in range(rng.randrange(40)):
            w = base[int(len(base) * rng.random() ** 2)]
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            words.append(rng.choice([w, w.upper(), w.title()]))
        out.append((d if d % 9 else None, rng.choice([" ", ", ", "1"]).join(words)))
    return out


def read(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize(("letters", "chunk"), [("ab", 2048), ("ab", 8), ("abcdé÷ÀÉ", 2048), ("abcdé÷ÀÉ", 4), ("a", 3)])
def test_equals_definition(spark, docs_schema, letters, chunk):
    rows = corpus(3, letters, 300) + [(900, None), (901, ""), (902, "12 - 日本"), (903, "x" * 3000 + " " + "x" * 2999 + " " + "xy" * 4000)] + [(904, "Tisch tisch TISCH tischs tischs tischs")] * 7
    rows += [(d, "x" * 3000 + " " + "x" * 2999) for d in range(1000, 1004)]
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema).withColumnRenamed("extra", "word")
    assert read(spelling.variants(df, drop_mod=7, chunk=chunk)) == brute(rows, mod=7)


def test_empty(spark, docs_schema):
    assert spelling.variants(spark.createDataFrame([], docs_schema)).collect() == []


def test_chain_of_forms(spark):
    """abcde -> abcdef -> abcdefg -> ... each at least twice as frequent: the root is the last."""
    words = ["abcdefghijklm"[:k] for k in range(5, 14)]
    rows = [(k, (w + " ") * (3 * 2 ** k)) for k, w in enumerate(words)]
    got = read(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), drop_mod=10 ** 9))
    assert [r[2] for r in got] == [words[-1]] * len(words) and got[0][1] == words[1] and got[-1][1] is None


def test_pivots_cost_least():
    rng = np.random.default_rng(4)
    pos = np.sort(np.stack([rng.choice(8, 3, replace=False) for _ in range(500)]), axis=1)
    cost = rng.integers(1, 9, pos.shape).astype(float)
    got = spelling.pivots(pos, cost)
    for p, c, g in zip(pos, cost, got, strict=True):
        pairs = [(c[i] + c[j], i, j) for i in range(3) for j in range(i + 1, 3) if p[j] - p[i] >= 2]
        i, j = np.flatnonzero(g)
        assert p[j] - p[i] >= 2 and c[i] + c[j] == min(pairs)[0]


def test_long_words_stay_linear():
    """A word of one letter has thousands of equal bigrams, and seven rows at most a side."""
    import pyarrow as pa
    order = {(ord("a") << 32) | ord("a"): (0, 1)}
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50_000]), pa.array([3])], names=["word", "n"])
    assert sum(b.num_rows for b in spelling.index_rows(order, False)(iter([batch]))) <= 2 * spelling.RANKS
