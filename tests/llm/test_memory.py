"""What a Python worker holds at once is bounded by parts of a block of texts, and the parts change no result."""
import tracemalloc

import numpy as np
import pyarrow as pa

from riskweave.llm import langid, linededup
from riskweave.llm.common import batch_slices, keep_rows


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(rng, words, n):
    return [" ".join(rng.choice(words, 60)) for _ in range(n)]


def test_language_of_a_block_of_texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(800)]
    texts = prose(rng, words[:400], 40) + prose(rng, words[400:], 40)
    model = langid.fit_rows([(t, f"l{k // 10}") for k, t in enumerate(texts)], steps=2)
    block = [" ".join(rng.choice(words, 600)) for _ in range(700)]  # 3 M characters
    assert peak_mb(lambda: langid.label_texts(block, model)) < 110


def test_language_is_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    model = langid.fit_rows([(t, lang) for lang, some in (("aa", words[:30]), ("bb", words[30:])) for t in prose(rng, some, 20)], steps=5)
    texts = [None, "", "12", *prose(rng, words, 9), None, "?", " ".join(words * 9), *prose(rng, words[:30], 5), "", None]
    whole = langid.label_texts(texts, model)
    for most in (1, 100, 130):
        monkeypatch.setattr(langid, "WORDS_AT_ONCE", most)
        got = langid.label_texts(texts, model)
        assert got.pred == whole.pred and np.allclose(got.score, whole.score) and (got.switches == whole.switches).all()
        assert (got.n_words == whole.n_words).all() and all((a == b).all() for a, b in zip(got.top, whole.top, strict=True))


def test_lines_of_a_block_of_texts():
    rng = np.random.default_rng(5)
    lines = ["".join(x) for x in rng.choice(list("abcdefgh "), (30_000, 100))]  # 3 M characters
    assert peak_mb(lambda: linededup.Banding(8, 10, 4)(lines)) < 80
    assert peak_mb(lambda: linededup.shingle_sets(lines, 8)) < 100
    sets, at = linededup.shingle_sets(lines, 8)
    p = np.arange(0, 30_000, 2)
    assert not linededup.similar(sets, at, p, p + 1, 0.8).any() and linededup.similar(sets, at, p, p, 0.8).all()
    long = [(x * 20)[k:] for k, x in enumerate(["".join(rng.choice(list("abcdefgh "), 1000)) for _ in range(8)] * 50)]
    sets, at = linededup.shingle_sets(long, 8)
    q = np.arange(400)
    both = np.repeat(q, 30), np.tile(q, 30)
    assert peak_mb(lambda: linededup.similar(sets, at, *both, 0.1)) < 100


def test_lines_are_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcde "), n)) for n in rng.integers(1, 400, 300)] + ["x", "é" * 5_000]
    p, q = rng.integers(0, len(lines), (2, 3000))
    whole = linededup.Banding(8, 10, 4)(lines), linededup.shingle_sets(lines, 8)
    near = linededup.similar(*whole[1], p, q, 0.3)
    for most in (1, 700, 20_000):
        monkeypatch.setattr(linededup, "HASH_CHARS", most)
        got = linededup.Banding(8, 10, 4)(lines), linededup.shingle_sets(lines, 8)
        for a, b in zip(whole, got, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
        assert np.array_equal(linededup.similar(*got[1], p, q, 0.3), near)
    assert not linededup.similar(*whole[1], p[:0], q[:0], 0.3).size


def test_slices_have_every_row_once():
    texts = [None, "", "a" * 50, "é" * 30, None, "b" * 500, "", "c", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = list(batch_slices(batch, 1, 100))
    assert [x for part in got for x in part.column(0).to_pylist()] == list(range(9)) and len(got) > 2
    assert list(batch_slices(batch.slice(0, 0), 1)) == []


def test_rows_are_kept_from_every_slice(spark):
    n = 60
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else "x" * 200_000 + str(k)) for k in range(n)], "doc_id long, text string").coalesce(1)
    most = 5_000_000  # a block of 4 MB and the text that ends it

    def accepted(texts):
        assert sum(len(t) for t in texts if t) < most
        return [t is None or t.endswith("1") for t in texts]

    assert sorted(r.doc_id for r in keep_rows(docs, "text", accepted).select("doc_id").collect()) == [k for k in range(n) if k % 7 == 0 or k % 10 == 1]
