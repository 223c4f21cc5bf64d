"""The digest index against a plain reading of its contract, over one batch and several."""
import hashlib
import random
import re

from riskweave.llm import exactdedup


def bare(t):
    return re.sub(r"[ \t-\r]", "", t or "")


def brute(rows):
    """(id, text) rows to the sorted results of one batch on an empty index."""
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for b, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        first = True
        for m in members:
            kept = first and m == best
            first = first and not kept
            out.append((m[3], hashlib.sha256(b.encode()).hexdigest(), -m[0], len(members), best[3], kept))
    return sorted(out, key=repr)


def read(df):
    return sorted(((r.doc_id, r.digest.hex(), r.n_chars, r.group_size, r.keep_id, r.kept) for r in df.collect()), key=repr)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\ré 日") for _ in range(rng.randrange(6))) for _ in range(60)] + ["long words " * 9000, None, "", " \n"]
    return [(rng.choice([None, *range(300)]), rng.choice(texts)) for _ in range(n)] + [(7, "hot  text")] * (n // 2) + [(3, "hot text")]


def test_equals_definition(spark, docs_schema):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, "x", None, None, "e") for i, t in rows], docs_schema).withColumnRenamed("extra", "digest")
    assert read(exactdedup.dedup(df)) == brute(rows)
    assert exactdedup.dedup(df.limit(0)).collect() == []


def test_later_batches_and_replay(spark, tmp_path):
    one, two = rows_of(2), rows_of(3) + [(i, f"new text {i % 50}") for i in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exactdedup.DigestIndex(spark, str(tmp_path / "index"), buckets=5)
    assert read(index.add(frame(one), "one")) == brute(one)
    known = {bare(t): k for (i, t), k in {(i, t): None for i, t in one}.items()}
    keep = {d: k for _, d, _, _, k, _ in brute(one)}
    want = sorted(((i, d, n, g, keep.get(d, k), kept and d not in keep) for i, d, n, g, k, kept in brute(two)), key=repr)
    reopened = exactdedup.DigestIndex(spark, str(tmp_path / "index"), buckets=99)  # as another session would
    assert reopened.buckets == 5
    assert read(reopened.add(frame(two), "two")) == want
    size = len(known | {bare(t): None for _, t in two})
    assert reopened.rows().count() == size == reopened.rows().select("digest").distinct().count()
    # the same batch once more: nothing is appended, the same decisions
    assert read(reopened.add(frame(two), "two")) == want
    assert reopened.rows().count() == size
    reopened.drop()
    assert not (tmp_path / "index").exists()


def test_index_side_is_not_shuffled(spark, tmp_path):
    index = exactdedup.DigestIndex(spark, str(tmp_path / "index"), buckets=5)
    index.add(spark.createDataFrame(rows_of(4), "doc_id long, text string"), "one").count()
    groups = spark.range(100).select(F_digest().alias("digest"))
    plan = groups.repartition(5, "digest").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan


def F_digest():
    from pyspark.sql import functions as F
    return F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))


def test_hot_group_meets_by_broadcast(spark):
    """A text that a third of the rows hold is joined without a shuffle of its rows; the rest have small groups."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    out = exactdedup.dedup(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    got = out.where("group_size > 1").collect()
    assert len(got) == 1000 and sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {0}
