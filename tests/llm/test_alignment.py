"""Alignment of tokens against a plain reading of the contract, text by text and byte by byte."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_chars():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokens(text, a, b, chars):
    """[(id, start, end)] of both, or None."""
    if not text:
        return None
    got = []
    for ids, show in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(chars[c] for c in a.id_to_token(i))),
                      (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        at, rows, joined = 0, [], b""
        for i in ids:
            x = show(i)
            rows.append((i, at, at + len(x)))
            at, joined = at + len(x), joined + x
        if joined != (" " + text).encode():
            return None
        got.append(rows)
    return got


def brute(rows):
    a, b, chars = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_chars()
    a.encode_special_tokens = True
    docs, count = [], Counter()
    for i, t in rows:
        got = tokens(t, a, b, chars)
        if got is None:
            docs.append((i, None, None, None))
            continue
        ends = sorted({e for _, _, e in got[0]} & {e for _, _, e in got[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(k) for k, s, e in side if lo <= s and e <= hi) for side in got))
            lo = hi
        links = [(x, y) for x, s, e in got[0] for y, u, v in got[1] if s < v and u < e]
        count.update(set(links))
        docs.append((i, got, groups, links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, got, groups, links in docs:
        out.append((i, 0, 0, 0, 0, 0, 0, "") if got is None else (
            i, len(got[0]), len(got[1]), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(8)
    words = ["the", "tokenizer", "naïve", "日本語", "🙂", "x1", "don't", "'s", "<|endoftext|>", "</s>", "<0x41>", "  ", "\n", "\t ", "a", "ABC-def", "ééé", " ", "\x1c", "1234567"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    made += ["".join(rng.choice(words) for _ in range(12)) for _ in range(20)]
    return [*made, None, "", " ", "  lead", "trail  ", "\n", "x", "with ▁ mark", "nul \0 byte", "word " * 400, "y" * 3000]


@pytest.mark.parametrize("chars", [6_000_000, 150])
def test_equals_definition(spark, docs_schema, chars):
    rows = [(None if k % 11 == 0 else k, t) for k, t in enumerate(texts())] + [(500, "the same row twice")] * 2
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema).withColumnRenamed("extra", "block")
    out, common = alignment.align(df, A, B, chars=chars)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == brute(rows)
    assert common.groupBy("a").agg({"n": "max"}).count() == common.where("best").select("a").distinct().count()


def test_uncut_texts_give_the_same(monkeypatch):
    """Texts taken as one stretch each, as for tokenizers whose files do not allow the cuts."""
    a, b = alignment.BytePair(A), alignment.Pieces(B)
    assert a.cuts and b.cuts
    some = texts()
    cut = alignment.block_record(0, list(range(len(some))), some, a, b)
    a.cuts = False
    whole = alignment.block_record(0, list(range(len(some))), some, a, b)
    one, two = (alignment.unpacked(r.column(4)[0].as_py()) for r in (cut, whole))
    assert [one[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [two[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    pairs = lambda r: sorted(p for p in zip(*(r.column(c)[0].as_py() for c in ("a", "b", "docs")), strict=True) if p[2])
    assert pairs(cut) == pairs(whole)


def test_pointers_reach_the_last_token():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < p) + 1, size) for p in rng.random(2))
        last = alignment.last_tokens(a, b)
        cuts = np.intersect1d(a, b)
        for k, end in enumerate([*a, *b]):
            assert last[k] == len(a) + np.searchsorted(b, cuts[np.searchsorted(cuts, end)])


def test_empty(spark, docs_schema):
    assert alignment.align(spark.createDataFrame([], docs_schema), A, B)[0].collect() == []
