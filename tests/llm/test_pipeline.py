"""The pipeline against a brute-force version of its stages, and what each stage must do with odd rows."""
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from riskweave.llm import langid
from riskweave.llm.queries import bpe_path

SF = "/root/testdata/sf0.001"


def components(n, alike):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and alike(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def similar(a, b, t=0.8):
    if min(len(a), len(b)) < t * max(len(a), len(b)):
        return False
    n = len(a & b)
    return n >= t * (len(a) + len(b) - n) - 1e-9


def grams(text, w=5):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[k:k + w]) for k in range(len(words) - w + 1)} or ({tuple(words)} if words else set())


def brute_lines(docs):
    lines = sorted((d, k, x) for d, t in docs.items() for k, x in enumerate(t.split("\n")) if x.strip())
    texts = sorted({x for _, _, x in lines})
    sets = [{x[k:k + 8] for k in range(len(x) - 7)} or {x} for x in texts]
    root = dict(zip(texts, components(len(texts), lambda i, j: similar(sets[i], sets[j])), strict=True))
    seen, keep = set(), defaultdict(set)
    for d, k, x in lines:
        if root[x] not in seen:
            seen.add(root[x])
            keep[d].add(k)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or k in keep[d]) for d, t in docs.items() if keep[d] or not t.strip()}


def test_equals_brute_force(spark):
    from tokenizers import Tokenizer
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table)
    docs = {r.doc_id: r.text for r in table.collect()}
    one = {d: langid.label_texts([t], model) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if one[d].pred[0] != "und" and one[d].score[0] >= 0.4}
    docs = brute_lines(docs)
    ids = sorted(docs)
    sets = [grams(docs[d]) for d in ids]
    root = components(len(ids), lambda i, j: bool(sets[i]) and similar(sets[i], sets[j]))
    docs = {d: docs[d] for i, d in enumerate(ids) if root[i] == i}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if not any(len(q & grams(t)) >= 0.8 * len(q) for q in items)}
    tok = Tokenizer.from_file(bpe_path())
    want = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in docs.items()}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want) and len(want) > 50
    for d, ids in want.items():
        assert sum(r.length for r in got[d]) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in got[d])


def test_stages_take_odd_rows_and_keep_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, DOC string, extra int"
    text = "the first line of a document that is kept\nand another line that nobody else has"
    rows = [(1, text, "en", "s", 1, "d", 1), (1, text, "en", "s", 1, "d", 1), (2, None, None, None, None, None, None), (3, "", "en", "", 0, "", 0), (None, "a line with a null id", "en", None, None, "", 1),
            (4, "und " * 40_000, "xx", "s", 5, "", 2), (5, "12 34", "en", "s", 5, "", 2)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.collect()
        assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len({r.doc_id for r in pieces}) == (6 if docs.count() else 0)


def test_stages_keep_columns_with_their_helpers_names(spark):
    """Columns that are called like a stage's own come back as they were."""
    from riskweave.llm import jaccardjoin, linededup
    from pyspark.sql import functions as F
    rows = [(1, "first line of the text\nsecond line of it here", 111), (2, "another text with words\nsecond line of it here", 222), (3, "one two three four five six seven", 333), (4, "one two three four five six seven", 444)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _did int").withColumns({"_th": F.col("_did") + 1, "_stay": F.col("_did") + 2, "_lines": F.col("_did") + 3, "th": F.col("_did") + 4})
    for stage, ids in ((linededup.drop_repeated_lines, {1, 2, 3}), (jaccardjoin.keep_one_of_each, {1, 2, 3})):
        got = stage(docs)
        assert got.columns == docs.columns
        out = {r.doc_id: (r._did, r._th, r._stay, r._lines, r.th) for r in got.collect()}
        assert out == {i: tuple(111 * i + k for k in range(5)) for i in ids}
