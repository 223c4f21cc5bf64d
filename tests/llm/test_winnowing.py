"""Winnowing against a direct reading of its definition, neighbours and edited texts included."""
import hashlib
import random

import pytest
import xxhash

from riskweave.llm import winnowing


def brute(text, k, w):
    grams = [text[i:i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
    h = [(xxhash.xxh64_intdigest(g.encode("utf-32-be"), seed=42) & 0x7FFFFFFF00000000) >> 32 for g in grams]
    out = []
    for s in range(max(1, len(h) - w + 1)):
        win = h[s:s + w]
        if win:
            low = min(win)
            p = s + max(i for i, x in enumerate(win) if x == low)
            if (low, p + 1) not in out:
                out.append((low, p + 1))
    return ",".join(f"{a:x}:{p}" for a, p in out), {a for a, _ in out}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("k", "w", "stretch"), [(16, 32, 1 << 14), (5, 8, 37)])
def test_equals_definition(spark, docs_schema, monkeypatch, k, w, stretch):
    plain = winnowing.winnow
    monkeypatch.setattr(winnowing, "winnow", lambda t, k, w: plain(t, k, w, stretch))
    rng = random.Random(6)
    texts = ["", None, "ab", "x" * 400, "é日本語🙂" * 30, "short text", "a b " * 9000]
    texts += ["".join(rng.choice("abcde 日🙂é") for _ in range(rng.randrange(1, 500))) for _ in range(60)]
    rows = [(None if d == 3 else d * 7 - 50, t) for d, t in enumerate(texts)] + [(5000, "one"), (5000, "two"), (5001, "twice"), (5001, "twice")]
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema)
    got = winnowing.fingerprints(df, k=k, window=w).collect()

    def th(t):
        x = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
        return x - (1 << 64) if x >> 63 else x

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, th(r[1])))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        (f, a), (e, b), (_, c) = (brute(x, k, w) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_match_guarantee(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(47))
    texts = [(d, "".join(rng.choice("ijklmnop") for _ in range(rng.randrange(200))) + passage + "".join(rng.choice("qrstuvw") for _ in range(rng.randrange(200)))) for d in range(12)]
    got = winnowing.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sets = [{x.split(":")[0] for x in r.fingerprint.split(",")} for r in got]
    assert all(a & b for a in sets for b in sets) and all(r.near_next > 0 for r in got)


def test_empty_and_single(spark, docs_schema):
    df = spark.createDataFrame([(1, "only one", None, None, None, "e")], docs_schema)
    assert winnowing.fingerprints(df.limit(0)).collect() == []
    assert winnowing.fingerprints(df).collect()[0].near_next == 1.0


def test_window_must_be_a_power_of_two():
    with pytest.raises(ValueError, match="power of 2"):
        winnowing.minima(winnowing.F.lit(None), 24)


def test_repeated_rows(spark):
    """A third of the rows are one row, some more are a row without id: all come back, and none of them crowds a range."""
    rng = random.Random(2)
    hot, lost = "hot " + "abc de" * 20, "no id " * 9
    rows = [(d, "".join(rng.choice("abcd ") for _ in range(rng.randrange(90)))) for d in range(400)] + [(150, hot)] * 300 + [(None, lost)] * 100 + [(9000, None)] * 60 + [(9000, "")] * 40
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = winnowing.fingerprints(df, per_partition=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in rows)
    copies = [r for r in got if r.doc_id == 150 and r.n_chars == len(hot)]
    fingerprint, own = brute(hot, 16, 32)
    cut = len(hot) // 4
    edited = hot[:len(hot) - cut] + hot[:cut]
    alike = [r for r in copies if r.near_next == 1.0]
    assert len(copies) == 300 and len(alike) >= 299 and {r.fingerprint for r in copies} == {fingerprint}
    assert {(r.edited_sha256, r.edited_fingerprint, round(r.near_edited, 9)) for r in alike} == {
        (hashlib.sha256(edited.encode()).hexdigest(), brute(edited, 16, 32)[0], round(jaccard(own, brute(edited, 16, 32)[1]), 9))}
    empty = [r for r in got if r.doc_id == 9000]
    first = brute(lost, 16, 32)[0]  # the table's last row is followed by its first
    assert len(empty) == 100 and all(r.fingerprint == "" and r.edited_fingerprint == "" for r in empty) and first in {r.fingerprint for r in got}
    assert sum(r.near_next == 0.0 for r in empty) == 1 and sum(r.near_next == 1.0 for r in empty) == 99

    keyed = df.select(winnowing.F.coalesce("doc_id", winnowing.F.lit(winnowing.LEAST)).alias("did"), winnowing.F.coalesce("text", winnowing.F.lit("")).alias("text"))
    keyed = keyed.withColumn("th", winnowing.F.xxhash64("text"))
    tally = keyed.groupBy("did", "th").agg(winnowing.F.count(winnowing.F.lit(1)).alias("n"))
    kept, single, per_range = winnowing.repeated(keyed, tally, 16)
    assert per_range == -(-900 // 16) and single.count() == 3
    assert kept.groupBy("did", "th").count().agg({"count": "max"}).first()[0] < per_range and kept.count() == 403


def test_one_row_repeated(spark):
    got = winnowing.fingerprints(spark.createDataFrame([(1, "all the same text")] * 50, "doc_id long, text string")).collect()
    assert len(got) == 50 and {(r.near_next, r.n_chars) for r in got} == {(1.0, 17)} and len({r.edited_sha256 for r in got}) == 1
