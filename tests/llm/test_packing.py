"""Packing: exact round trip against the tokenizers library, no gaps, capacity kept, little padding."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import packing
from riskweave.llm.queries import bpe_path


def check(rows, texts, seq_len):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*(tok.encode(text, add_special_tokens=False).ids if text else []), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return by_seq


@pytest.mark.parametrize("window", [3, 4096])
def test_round_trip(spark, docs_schema, window):
    texts = {1: "word " * 900, 2: None, 3: "", 4: "naïve façade <|endoftext|> ünï", 5: "x" * 12_000, 6: "a\n\n  b\t " * 300,
             7: "7 8 9's don't", 8: "日本語 text " * 50}
    df = spark.createDataFrame([(k, t, None, None, None, "e") for k, t in texts.items()], docs_schema).coalesce(1)
    rows = packing.pack(df, bpe_path(), seq_len=64, window=window).collect()
    by_seq = check(rows, texts, 64)
    if window > 100:
        total = sum(r.length for r in rows)
        assert len(by_seq) == -(-total // 64)


def test_empty_null_ids_and_repeats(spark, docs_schema):
    assert packing.pack(spark.createDataFrame([], docs_schema), bpe_path()).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a b", None, None, None, None)] * 3, docs_schema), bpe_path()).collect()
    assert len(rows) == 3 and {r.doc_id for r in rows} == {None}


@given(st.lists(st.integers(1, 1024), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_place_never_wastes_more_than_one_sequence(lengths):
    placed, n_seq = packing.place(np.array(lengths), 1024, 1.0, 1 / 1024)
    assert n_seq == -(-sum(lengths) // 1024)
    got = defaultdict(int)
    for i, _, n, _, _ in placed:
        got[i] += n
    assert [got[i] for i in range(len(lengths))] == lengths
